"""Licence texts as they are published: wrapped, and behind comment marks."""

import textwrap

import pytest

from chronofold.llm.licences import ORACLE_SQL, RULES, SENTENCES, op10_licence_scan, scan

TEXT = dict(SENTENCES)


def wrapped(mark, end):
    rows = []
    for name, ids in RULES:
        if len(ids) > 1 or ids == ("isc-grant",):
            for width in (40, 60, 78):
                lines = ["Copyright (c) 2020 Someone", "All rights reserved.", ""]
                for i in ids:
                    lines += [*textwrap.wrap(TEXT[i], width), *([] if TEXT[i].endswith(".") else [""])]
                rows.append((f"{name} {width}", end.join(mark + x for x in lines)))
    return rows


@pytest.mark.parametrize("mark", ["", "# ", " * ", "// "])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_wrapped_licences(spark, mark, end):
    rows = wrapped(mark, end)
    got = {r["doc_id"]: r for r in scan(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    for key, _ in rows:
        assert got[key]["licences"] == [key.split(" ")[0]] and "reserved" in got[key]["sentence_ids"], key


def test_the_longest_rule_wins_where_it_stands(spark):
    two, three = (" ".join(TEXT[i] + "\n\n" for i in ids) for name, ids in RULES if name.startswith("BSD-") and len(ids) > 1)
    rows = [(1, two), (2, three), (3, two + three), (4, three + two), (5, three + three), (6, "SPDX-License-Identifier: BSD-2-Clause\n" + three)]
    got = {r["doc_id"]: r["licences"] for r in scan(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    both = ["BSD-2-Clause", "BSD-3-Clause"]
    assert got == {1: both[:1], 2: both[1:], 3: both, 4: both, 5: both[1:], 6: both}


def test_the_oracle_reads_wrapped_texts_alike(spark, tmp_path):
    import duckdb

    rows = [t for mark, end in (("", "\n"), ("# ", "\r\n"), (" * ", "\n")) for _, t in wrapped(mark, end)]
    rows += ["You may obtain a copy\n\nof the License at", "\r\r\nMIT License\r\n\r\nAll rights reserved. MIT\nLicense", None, ""]
    spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in op10_licence_scan(spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert got == sorted(con.execute(ORACLE_SQL).fetchall()) and sum(bool(r[4]) for r in got) >= len(rows) - 4


def test_a_blank_line_ends_a_sentence(spark):
    rows = [(1, "You may obtain a copy\nof the License at"), (2, "You may obtain a copy\n\nof the License at"), (3, "You may obtain a copy\n#\n# of the License at"), (4, "now You may obtain a copy\nof the License at")]
    got = {r["doc_id"]: r["sentence_ids"] for r in scan(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert got == {1: ["apache2-copy"], 2: [], 3: [], 4: []}
