import pytest

LONG = "alpha beta gamma delta epsilon zeta eta theta " * 4000


@pytest.fixture(scope="session")
def odd_dir(spark, tmp_path_factory):
    """Tables with nulls everywhere, empty and long texts, ties, repeated rows and clashing extra columns."""
    root = tmp_path_factory.mktemp("odd")
    extra = "score double, set_id long, n string, u string, word string, rate double, h string, block int, component_id string"
    filler = (0.5, 7, "n", "u", "w", 1.0, "h", 3, "c")
    base = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"
    texts = [
        (0, base, "en", "a"), (1, base, "en", "a"), (2, base.upper(), "en", "a"), (3, base + " more", "en", "b"), (3, base + " more", "en", "b"),
        (4, None, "en", "a"), (5, "", "de", None), (6, " \n\t ", None, "b"), (7, LONG, "de", "a"), (None, "x", "en", "a"), (8, "x", None, "a"),
        (9, "die das und der ein " * 30, "de", "c"), (10, "漢字 кириллица 😀 'tis I'll", "xx", "c"), (11, "12345 !!! ...", "en", "c"), (12, "two words", "en", "a"),
        (13, "Released under the MIT License. Done.\nLicensed under CC BY-NC 4.0.", "en", "a"), (14, LONG + "tail end here", "de", "a"), (15, "idiot moron trash " * 9, "en", "a"),
    ]
    rows = [(i, t, lang, s, None if t is None else len(t), *filler) for i, t, lang, s in texts]
    ddl = f"doc_id long, text string, lang string, source string, n_chars long, {extra}"
    tables = {
        "documents": (rows, ddl),
        "labels": ([(i, 1, int(i % 3 == 0)) for i in range(16)] + [(None, 1, 1), (3, None, None), (4, 0, 7), (1, 1, 1)], "doc_id long, quality int, toxic int"),
        "pages": ([(1, "HTTPS://A.Example.COM/en/7?x=1", None, 1), (2, None, None, 2), (3, "no scheme", "", 3), (4, "http://sub.example.net/de/9#f", "", 4), (5, "http://h.org/xxx", "", 5), (6, "http://h.org/adult-casino", "", 6), (6, "http://h.org/adult-casino", "", 6), (None, "http://com/en/", "", 7)], "page_id long, url string, html string, host int"),
        "embeddings": ([(i, [float(i % 7) / 7, 0.25, -0.5]) for i in range(120)] + [(150, None), (200, [1.0, None, 2.0]), (250, [float("nan"), 0.0, 0.0]), (300, [1.0]), (None, [1.0, 1.0, 1.0]), (0, [0.0, 0.25, -0.5]), (350, [])], "vec_id long, embedding array<float>"),
    }
    for name, (data, ddl_) in tables.items():
        spark.createDataFrame(data, ddl_).repartition(3).write.parquet(f"{root}/{name}.parquet")
    return str(root)


@pytest.fixture(scope="session")
def empty_dir(spark, odd_dir, tmp_path_factory):
    root = tmp_path_factory.mktemp("empty")
    for name in ("documents", "labels", "pages", "embeddings"):
        spark.read.parquet(f"{odd_dir}/{name}.parquet").limit(0).write.parquet(f"{root}/{name}.parquet")
    return str(root)
