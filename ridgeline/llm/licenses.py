"""Licence recognition by sentences and ordered rules.

A text is cut into sentences, each is normalised and looked up among known
licence sentences. Sentences that run over lines and aren't known as a whole are
looked up line by line, so a licence line below an unfinished line is found, and
so is a wrapped sentence. The identifiers, with a mark for each stretch of other
sentences, form a sequence; rules are tried in order, and what a rule matches is
taken out of the sequence, so a full licence isn't reported again by its parts.
List markers between two known sentences aren't part of the sequence; the SQL
keeps them as other sentences, so it misses numbered licences.

Everything is one row-wise expression: no shuffle, and texts without any of
the words that all known sentences share some of skip it.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, table, text_column

#: Known sentences by identifier (fixed values, as published in the licences and their usual notices).
SENTENCES: list[tuple[str, str]] = [
    ("ApacheShort", "Licensed under the Apache License, Version 2.0."),
    ("ApacheShort", "Licensed under the Apache License 2.0."),
    ("ApacheShort", "Released under the Apache License, Version 2.0."),
    ("ApacheGrant", 'Licensed under the Apache License, Version 2.0 (the "License");'),
    ("ApacheCompliance", "you may not use this file except in compliance with the License."),
    ("ApacheCopy", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("CopyBelowApache", "You may obtain a copy of the License at\n\nhttp://www.apache.org/licenses/LICENSE-2.0"),
    ("ApacheNoWarranty", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'),
    ("ApacheSee", "See the License for the specific language governing permissions and limitations under the License."),
    ("MITShort", "Released under the MIT License."),
    ("MITShort", "Licensed under the MIT License."),
    ("MITShort", "This project is licensed under the MIT License."),
    ("MITTitle", "The MIT License (MIT)"),
    ("MITGrant", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("MITNotice", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("MITNoWarranty", 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.'),
    ("ISCGrant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("BSDGrant", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSDSource", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("BSDBinary", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSDEndorse", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSDShort", "Licensed under the BSD License."),
    ("BSD3Short", "Licensed under the BSD 3-Clause License."),
    ("GPL3Short", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL3Short", "Licensed under the GNU General Public License, version 3."),
    ("GPL2Short", "Licensed under the GNU General Public License, version 2."),
    ("GPL3Later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL2Later", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPLNoWarranty", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."),
    ("GPLSee", "See the GNU General Public License for more details."),
    ("LGPL3Short", "Licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL3Short", "Licensed under the GNU Affero General Public License, version 3."),
    ("MPL2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL2Copy", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("CCBY", "Licensed under CC BY 4.0."),
    ("CCBY", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CCBYSA", "Licensed under CC BY-SA 4.0."),
    ("CCBYSA", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CCBYNC", "Licensed under CC BY-NC 4.0."),
    ("CCBYNC", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CCBYND", "Licensed under CC BY-ND 4.0."),
    ("CC0", "Licensed under CC0 1.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Reserved", "All rights reserved, no licence is granted."),
    ("Reserved", "All rights reserved."),
]

#: Rules in the order in which they are tried: licence, then identifiers that follow each other.
RULES: list[tuple[str, tuple[str, ...]]] = [
    ("Apache-2.0", ("ApacheGrant", "ApacheCompliance", "ApacheCopy", "ApacheNoWarranty", "ApacheSee")),
    ("Apache-2.0", ("ApacheGrant", "ApacheCompliance", "CopyBelowApache", "ApacheNoWarranty", "ApacheSee")),
    ("Apache-2.0", ("ApacheGrant", "ApacheCompliance", "ApacheCopy")),
    ("Apache-2.0", ("ApacheGrant", "ApacheCompliance", "CopyBelowApache")),
    ("Apache-2.0", ("ApacheGrant",)),
    ("Apache-2.0", ("ApacheShort",)),
    ("MIT", ("MITTitle", "MITGrant", "MITNotice", "MITNoWarranty")),
    ("MIT", ("MITGrant", "MITNotice", "MITNoWarranty")),
    ("MIT", ("MITGrant", "MITNotice")),
    ("MIT", ("MITTitle",)),
    ("MIT", ("MITShort",)),
    ("ISC", ("ISCGrant",)),
    ("BSD-3-Clause", ("Reserved", "BSDGrant", "BSDSource", "BSDBinary", "BSDEndorse")),
    ("BSD-2-Clause", ("Reserved", "BSDGrant", "BSDSource", "BSDBinary")),
    ("BSD-1-Clause", ("Reserved", "BSDGrant", "BSDSource")),
    ("BSD-3-Clause", ("BSDGrant", "BSDSource", "BSDBinary", "BSDEndorse")),
    ("BSD-2-Clause", ("BSDGrant", "BSDSource", "BSDBinary")),
    ("BSD-1-Clause", ("BSDGrant", "BSDSource")),
    ("BSD-3-Clause", ("BSD3Short",)),
    ("BSD", ("BSDShort",)),
    ("GPL-3.0-or-later", ("GPL3Later", "GPLNoWarranty", "GPLSee")),
    ("GPL-3.0-or-later", ("GPL3Later",)),
    ("GPL-2.0-or-later", ("GPL2Later", "GPLNoWarranty", "GPLSee")),
    ("GPL-2.0-or-later", ("GPL2Later",)),
    ("GPL-3.0-only", ("GPL3Short",)),
    ("GPL-2.0-only", ("GPL2Short",)),
    ("LGPL-3.0-only", ("LGPL3Short",)),
    ("AGPL-3.0-only", ("AGPL3Short",)),
    ("MPL-2.0", ("MPL2", "MPL2Copy")),
    ("MPL-2.0", ("MPL2",)),
    ("CC-BY-4.0", ("CCBY",)),
    ("CC-BY-SA-4.0", ("CCBYSA",)),
    ("CC-BY-NC-4.0", ("CCBYNC",)),
    ("CC-BY-ND-4.0", ("CCBYND",)),
    ("CC0-1.0", ("CC0",)),
    ("Unlicense", ("Unlicense",)),
    ("NONE-GRANTED", ("Reserved",)),
]

#: Every known sentence has one of these words; texts without them hold none.
KEYWORDS = ("licen", "permission", "redistribut", "warrant", "mpl", "domain", "reserved")

#: A sentence ends at a stop with white space after it, or at an empty line.
BREAK = r"([.!?;:])[\x20\x09-\x0D]+|\n[\x20\x09-\x0D]*\n"
CUT = "\x01"

#: Pieces that are no sentence: a list marker (a bare number or a single letter) or no letter or digit at all.
MARKER = r"^[^\p{L}\p{N}]*+(?:[0-9]++|[A-Za-z])?+[^\p{L}\p{N}]*+$"


def pieces_of(sentence: str) -> list[str]:
    """A known sentence as the splitter would cut it."""
    return [x for x in re.sub(BREAK, lambda m: (m[1] or "") + CUT, sentence).split(CUT) if x]


def normal(sentence: str) -> str:
    return re.sub(r"[^a-z0-9]+", " ", sentence.lower()).strip()


def known(sentences: list[tuple[str, str]]) -> dict[str, str]:
    """Normalised sentence to identifier; of a sentence with stops inside, each part but the first gets a numbered one."""
    out: dict[str, str] = {}
    for name, sentence in sentences:
        for i, part in enumerate(pieces_of(sentence)):
            out.setdefault(normal(part), name if not i else f"{name}+{i}")
    return out


def patterns(sentences: list[tuple[str, str]], rules: list[tuple[str, tuple[str, ...]]]) -> list[tuple[str, str]]:
    """Licence and the text of each rule's sequence, every sentence with all its parts (two sentences may share one)."""
    names, spelled = known(sentences), {}
    for name, sentence in sentences:
        parts = "".join(f"<{names[normal(x)]}>" for x in pieces_of(sentence))
        if spelled.setdefault(name, parts) != parts:
            raise ValueError(f"sentences for {name} have different parts")
    return [(licence, "".join(spelled[x] for x in sequence)) for licence, sequence in rules]


def _normal(sentence: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(sentence), "[^a-z0-9]+", " "))


def recognise(df: DataFrame, id_column: str = "doc_id", text: str = "text", sentences: list[tuple[str, str]] = SENTENCES, rules: list[tuple[str, tuple[str, ...]]] = RULES) -> DataFrame:
    """One row per input row: doc_id, licences, sequence, n_known, n_unused.

    ``licences`` are the distinct ones found, in order of the rules, joined by commas;
    ``sequence`` the identifiers in order of the text, with <?> for each stretch of
    other sentences between them; ``n_unused`` counts known sentences that no rule took.
    A sentence also ends at U+0001. A null, empty or blank text has none. Rows that repeat get equal results, a null id
    stays null, other columns are ignored, and an empty table gives no rows.
    """
    table_ = known(sentences)
    if not all(any(k in sentence.lower() for k in KEYWORDS) for _, sentence in sentences):
        raise ValueError("a known sentence has none of the keywords")
    lookup = F.create_map(*[F.lit(x) for pair in table_.items() for x in pair])
    docs = df.select(column(df, id_column).alias("doc_id"), text_column(df, text).alias("text"))
    suspect = F.lower("text").rlike("|".join(KEYWORDS))

    def identify(sentence: Column) -> Column:
        name = F.try_element_at(lookup, _normal(sentence))
        by_line = F.transform(F.split(sentence, "\n", -1), lambda x: F.coalesce(F.try_element_at(lookup, _normal(x)), F.lit("?")))
        return F.when(name.isNotNull(), F.array(name)).when(sentence.rlike(MARKER), F.array(F.lit("."))).when(F.instr(sentence, "\n") > 0, by_line).otherwise(F.array(F.lit("?")))

    cut = F.split(F.regexp_replace("text", BREAK, "$1" + CUT), CUT, -1)
    names = F.filter(F.flatten(F.transform(F.filter(cut, lambda x: F.trim(F.regexp_replace(x, r"[\x20\x09-\x0D]+", " ")) != ""), identify)), lambda x: x.isNotNull())
    joined = F.array_join(F.transform(names, lambda x: F.concat(F.lit("<"), x, F.lit(">"))), "")
    joined = F.regexp_replace(F.regexp_replace(joined, r"(?<=[A-Za-z0-9]>)(<\.>)+(?=<[A-Z])", ""), r"<\.>", "<?>")
    sequence = F.when(suspect, F.regexp_replace(joined, r"(<\?>)+", "<?>")).otherwise("")
    steps = F.array(*[F.struct(F.lit(licence).alias("licence"), F.lit(pattern).alias("pattern")) for licence, pattern in patterns(sentences, rules)])
    start = F.struct(F.col("sequence").alias("rest"), F.array().cast("array<string>").alias("found"))

    def step(state: Column, rule: Column) -> Column:
        hit = F.contains(state["rest"], rule["pattern"])
        return F.struct(F.when(hit, F.replace(state["rest"], rule["pattern"], F.lit("<#>"))).otherwise(state["rest"]).alias("rest"), F.when(hit, F.concat(state["found"], F.array(rule["licence"]))).otherwise(state["found"]).alias("found"))

    def count(text_: Column) -> Column:
        return F.regexp_count(text_, F.lit("<[A-Za-z0-9+]+>")).cast("long")

    found = docs.select("doc_id", sequence.alias("sequence")).select("doc_id", F.when(F.col("sequence").contains("<") & F.col("sequence").rlike("<[A-Z]"), F.col("sequence")).otherwise("").alias("sequence"))
    nothing = F.struct(F.lit("").alias("rest"), F.array().cast("array<string>").alias("found"))
    found = found.select("doc_id", "sequence", F.when(F.col("sequence") != "", F.aggregate(steps, start, step)).otherwise(nothing).alias("result"))
    return found.select("doc_id", F.array_join(F.array_distinct("result.found"), ",").alias("licences"), "sequence", count(F.col("sequence")).alias("n_known"), count(F.col("result.rest")).alias("n_unused"))


def op1(spark, sf_dir: str) -> DataFrame:
    return recognise(table(spark, sf_dir, "documents"))


def oracle_sql(sentences: list[tuple[str, str]] = SENTENCES, rules: list[tuple[str, tuple[str, ...]]] = RULES) -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({quote(s)}, {quote(n)})" for s, n in known(sentences).items())
    rest, found = "sequence", []
    steps = []
    for i, (licence, pattern) in enumerate(patterns(sentences, rules)):
        steps.append(f"r{i} AS (SELECT doc_id, rid, sequence, replace(rest, {quote(pattern)}, '<#>') AS rest, CASE WHEN contains(rest, {quote(pattern)}) AND NOT list_contains(found, {quote(licence)}) THEN list_append(found, {quote(licence)}) ELSE found END AS found FROM {f'r{i - 1}' if i else 's'})")
        rest, found = f"r{i}", licence
    return rf"""
WITH k(sentence, name) AS (VALUES {values}),
d AS (SELECT doc_id, row_number() OVER () AS rid, regexp_matches(lower(coalesce(text, '')), '{'|'.join(KEYWORDS)}') AS suspect, string_split(regexp_replace(coalesce(text, ''), '([.!?;:])[\x20\x09-\x0D]+|\n[\x20\x09-\x0D]*\n', '\1' || chr(1), 'g'), chr(1)) AS parts FROM documents),
u AS (SELECT rid, unnest(range(1, len(parts) + 1)) AS pos, unnest(parts) AS part FROM d),
w AS (SELECT rid, pos, part, trim(regexp_replace(lower(part), '[^a-z0-9]+', ' ', 'g')) AS norm FROM u WHERE regexp_replace(part, '[\x20\x09-\x0D]+', '', 'g') <> ''),
v AS (SELECT w.rid, w.pos, w.part, k.name FROM w LEFT JOIN k ON w.norm = k.sentence),
l AS (SELECT rid, pos, unnest(range(1, len(string_split(part, chr(10))) + 1)) AS line, unnest(string_split(part, chr(10))) AS part FROM v WHERE name IS NULL),
m AS (SELECT l.rid, l.pos, l.line, coalesce(k.name, '?') AS name FROM l LEFT JOIN k ON trim(regexp_replace(lower(l.part), '[^a-z0-9]+', ' ', 'g')) = k.sentence
      UNION ALL SELECT rid, pos, 1, name FROM v WHERE name IS NOT NULL),
q AS (SELECT rid, regexp_replace(string_agg('<' || name || '>', '' ORDER BY pos, line), '(<\?>)+', '<?>', 'g') AS sequence FROM m GROUP BY rid),
s AS (SELECT d.doc_id, d.rid, CASE WHEN d.suspect AND regexp_matches(coalesce(q.sequence, ''), '<[A-Z]') THEN q.sequence ELSE '' END AS sequence,
      CASE WHEN d.suspect AND regexp_matches(coalesce(q.sequence, ''), '<[A-Z]') THEN q.sequence ELSE '' END AS rest, []::VARCHAR[] AS found FROM d LEFT JOIN q USING (rid)),
{", ".join(steps)}
SELECT doc_id, coalesce(array_to_string(found, ','), '') AS licences, sequence, len(regexp_extract_all(sequence, '<[A-Za-z0-9+]+>')) AS n_known, len(regexp_extract_all(rest, '<[A-Za-z0-9+]+>')) AS n_unused FROM {rest}
"""
