"""Operator 10: licence scan by sentence rules, in DataFrame functions only.

A text is cut into sentences at line ends and after ``.``, ``!`` or ``?`` before white space. A sentence is
normalised (A-Z lower-cased, every run of other characters than letters a-z and digits is one space)
and looked up among the known licence sentences. The identifiers of a text, in order, are matched
against the licence rules: a rule is an ordered list of identifiers that must occur in that order;
other identifiers may stand between. The longest rule wins: where a longer rule goes on from the same
identifiers, up to the next occurrence of the first one, the shorter is not reported there.

Published texts are wrapped, and stand behind comment marks. So a known sentence is also found where
it fills several lines in a row that no blank line, and no end of a sentence, parts: marks and breaks are
spaces once normalised. Such a find stands at its first line, after that line's own. ``n_sentences`` counts pieces between line ends
and ends of sentences, wrapped or not.

Everything is local to a row: no shuffle, no join, and both tables are fixed and small. Null and empty
texts have no sentences and no licences. Repeated rows are scanned each on their own. The added
columns replace input columns of these names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Identifier and sentence, as published licences and notices word them.
SENTENCES = (
    ("mit-notice", "Released under the MIT License."),
    ("mit-notice", "Licensed under the MIT License."),
    ("mit-notice", "This project is licensed under the MIT License."),
    ("mit-title", "MIT License"),
    ("mit-title", "The MIT License (MIT)"),
    ("mit-grant", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("mit-keep", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("isc-grant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("apache2-notice", "Licensed under the Apache License, Version 2.0."),
    ("apache2-notice", "This project is licensed under the Apache License 2.0."),
    ("apache2-header", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("apache2-copy", "You may obtain a copy of the License at"),
    ("bsd-grant", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("bsd-source", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("bsd-binary", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("bsd-names", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("gpl3-notice", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl3-notice", "Licensed under the GNU General Public License v3.0."),
    ("gpl-free", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl-hope", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."),
    ("gpl2-free", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("lgpl2-free", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("agpl3-free", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("lgpl-hope", "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."),
    ("zlib-as-is", "This software is provided 'as-is', without any express or implied warranty."),
    ("zlib-grant", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
    ("boost-notice", "Distributed under the Boost Software License, Version 1.0."),
    ("mpl2-notice", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("cc-by-nc-4-notice", "Licensed under CC BY-NC 4.0."),
    ("cc-by-4-notice", "Licensed under CC BY 4.0."),
    ("cc-by-sa-4-notice", "Licensed under CC BY-SA 4.0."),
    ("cc0-notice", "Released under CC0 1.0."),
    ("unlicense-public", "This is free and unencumbered software released into the public domain."),
    ("reserved", "All rights reserved."),
)
#: Licence and the identifiers that must occur in order; any one rule suffices.
RULES = (
    ("MIT", ("mit-notice",)),
    ("MIT", ("mit-grant", "mit-keep")),
    ("ISC", ("isc-grant",)),
    ("Apache-2.0", ("apache2-notice",)),
    ("Apache-2.0", ("apache2-header", "apache2-copy")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names")),
    ("GPL-3.0", ("gpl3-notice",)),
    ("GPL-3.0-or-later", ("gpl-free", "gpl-hope")),
    ("GPL-2.0-or-later", ("gpl2-free", "gpl-hope")),
    ("AGPL-3.0-or-later", ("agpl3-free", "gpl-hope")),
    ("LGPL-2.1-or-later", ("lgpl2-free", "lgpl-hope")),
    ("Zlib", ("zlib-as-is", "zlib-grant")),
    ("BSL-1.0", ("boost-notice",)),
    ("MPL-2.0", ("mpl2-notice",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-4-notice",)),
    ("CC-BY-4.0", ("cc-by-4-notice",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-4-notice",)),
    ("CC0-1.0", ("cc0-notice",)),
    ("Unlicense", ("unlicense-public",)),
)
#: Every licence above may also be named by a tag line of its own.
TAGGED = tuple(dict.fromkeys(name for name, _ in RULES))
SENTENCES += tuple((f"spdx-{name}", f"SPDX-License-Identifier: {name}") for name in TAGGED)
RULES += tuple((name, (f"spdx-{name}",)) for name in TAGGED)
UPPER, LOWERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Where sentences end; \v is left to the normalisation, which reads it as a space.
END = r"[\r\n]+|[.!?][ \t\r\n]+"
OTHER = "[^a-z0-9]+"
#: Where sentences end that go on over lines: also at a line with nothing but marks.
STOP = r"[.!?][ \t\r\n]+|(?:\r\n|\n|\r(?!\n))[^a-z0-9\r\n]*[\r\n]"
BREAK = r"[\r\n]+"


def normalised(sentence: str) -> str:
    """The key of a sentence, as the columns below make it."""
    import re

    return re.sub(OTHER, " ", sentence.translate(str.maketrans(UPPER, LOWERED))).strip(" ")


def keys() -> dict[str, str]:
    """Normalised pieces of the known sentences and their identifiers; a known sentence that itself
    splits is known by its longest piece."""
    import re

    return {max(map(normalised, re.split(END, s)), key=len): i for i, s in SENTENCES}


def longer(ids: tuple[str, ...]) -> list[tuple[str, ...]]:
    """The rules that go on where ``ids`` ends."""
    return [other for _, other in RULES if len(other) > len(ids) and other[: len(ids)] == ids]


def pattern(ids: tuple[str, ...]) -> str:
    return "%" + "%".join(f"|{i}|" for i in ids) + "%"


def obeys(line: Column, ids: tuple[str, ...]) -> Column:
    """A line of identifiers in bars obeys a rule, and no longer rule in its place."""
    if not (more := longer(ids)):
        return line.like(pattern(ids))

    def here(part: Column) -> Column:
        out = part.like(pattern(ids[1:]))
        for other in more:
            out &= ~part.like(pattern(other[1:]))
        return out

    parts = F.split(line, rf"\|{ids[0]}\|")  # what follows each occurrence of the first identifier
    return F.exists(F.slice(parts, F.lit(2), F.size(parts)), here)


def sentences(text: Column) -> Column:
    """array<array<string>>: the normalised lines of each sentence; all lines in order are the pieces between ENDs."""
    low = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWERED)
    line = lambda s: F.btrim(F.regexp_replace(s, OTHER, " "), F.lit(" "))
    return F.transform(F.split(low, STOP), lambda s: F.filter(F.transform(F.split(s, BREAK), line), lambda x: x != ""))


def known_at(lines: Column, known: dict[str, str]) -> Column:
    """Numbers (from 1) of the known sentences that a line, or several lines in a row, of a sentence make up."""
    spots = F.array(*map(F.lit, known))
    starts = F.array(*[F.lit(k) for k in sorted({k.split(" ")[0] for k in known})])
    most = max(k.count(" ") + 1 for k in known)  # a line has a word at least

    def over(i: Column) -> Column:
        """From line i (from 0) on, over two lines and more."""
        two = F.concat_ws(" ", F.get(lines, i), F.get(lines, i + 1), F.lit(""))
        begun = F.array_contains(starts, F.substring_index(two, " ", 1)) & F.exists(spots, lambda k: F.startswith(F.concat(k, F.lit(" ")), two))
        ends = F.sequence(F.lit(2), F.least(F.size(lines) - i, F.lit(most)))
        return F.when((i + 1 < F.size(lines)) & begun, F.transform(ends, lambda n: F.array_position(spots, F.array_join(F.slice(lines, i + 1, n), " ")).cast("int"))).otherwise(F.array().cast("array<int>"))

    found = F.flatten(F.transform(lines, lambda x, i: F.concat(F.array(F.array_position(spots, x).cast("int")), over(i))))
    return F.filter(found, lambda k: k > 0)


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` plus n_sentences, sentence_ids (in order) and licences (sorted, distinct)."""
    known = keys()
    names = F.array(*map(F.lit, known.values()))
    docs = docs.drop("n_sentences", "sentence_ids", "licences")
    found = docs.withColumn("sentence_ids", sentences(F.col(text)))
    found = found.withColumn("n_sentences", F.size(F.flatten("sentence_ids")).cast("long"))
    at = F.flatten(F.transform("sentence_ids", lambda lines: known_at(lines, known)))
    found = found.withColumn("sentence_ids", F.transform(at, lambda k: F.element_at(names, k)))
    line = F.concat(F.lit("|"), F.array_join("sentence_ids", "||"), F.lit("|"))
    hits = [F.when(obeys(line, ids), F.lit(name)) for name, ids in RULES]
    return found.withColumn("licences", F.array_sort(F.array_distinct(F.array_compact(F.array(*hits)))))


def op10_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "n_sentences", F.size("sentence_ids").cast("long").alias("n_known"), F.array_join("sentence_ids", ",").alias("sentence_ids"), F.array_join("licences", ",").alias("licences"))


def _oracle() -> str:
    """Independent of the columns above: every run of lines of a sentence is put together and looked up."""
    known = keys()
    values = ", ".join(f"('{k}', '{i}')" for k, i in known.items())
    starts = ", ".join(f"'{k}'" for k in sorted({k.split(" ")[0] for k in known}))
    most = max(k.count(" ") + 1 for k in known)

    def hit(ids: tuple[str, ...]) -> str:
        if not (more := longer(ids)):
            return f"line like '{pattern(ids)}'"
        tests = " and ".join([f"x like '{pattern(ids[1:])}'", *(f"x not like '{pattern(o[1:])}'" for o in more)])
        return f"len(list_filter(string_split(line, '|{ids[0]}|')[2:], lambda x: {tests})) > 0"

    hits = ", ".join(f"case when {hit(ids)} then '{name}' end" for name, ids in RULES)
    return f"""
with k(sentence, id) as (values {values}),
t as (select doc_id, row_number() over () as rn, replace(translate(coalesce(text, ''), '{UPPER}', '{LOWERED}'), chr(13) || chr(10), chr(10)) as low from documents),
s as (select rn, unnest(string_split(regexp_replace(low, '[.!?][ \x09\x0D\x0A]+|[\x0D\x0A][^a-z0-9\x0D\x0A]*[\x0D\x0A]', chr(1), 'g'), chr(1))) as s,
        unnest(range(1, 1 + len(string_split(regexp_replace(low, '[.!?][ \x09\x0D\x0A]+|[\x0D\x0A][^a-z0-9\x0D\x0A]*[\x0D\x0A]', chr(1), 'g'), chr(1))))) as nth from t),
l as (select rn, nth, list_filter(list_transform(regexp_split_to_array(s, '[\x0D\x0A]+'), lambda x: trim(regexp_replace(x, '{OTHER}', ' ', 'g'), ' ')), lambda x: x <> '') as ls from s),
b as (select rn, nth, ls, unnest(range(1, len(ls) + 1)) as i from l),
r as (select rn, nth, i, unnest(range(i, least(len(ls) + 1, i + {most}))) as j, ls from b where string_split(ls[i], ' ')[1] in ({starts})),
f as (select rn, string_agg(id, ',' order by nth, i, j) as ids, count(*) as n from r join k on k.sentence = array_to_string(ls[i:j], ' ') group by rn),
c as (select rn, sum(len(ls)) as n from l group by rn),
j as (select t.doc_id, coalesce(c.n, 0) as n_sentences, coalesce(f.n, 0) as n_known, coalesce(ids, '') as sentence_ids, '|' || replace(coalesce(ids, ''), ',', '||') || '|' as line
      from t left join c using (rn) left join f using (rn))
select doc_id, cast(n_sentences as bigint) as n_sentences, cast(n_known as bigint) as n_known, sentence_ids,
       array_to_string(list_sort(list_distinct(list_filter([{hits}], lambda x: x is not null))), ',') as licences
from j"""


ORACLE_SQL = _oracle()
