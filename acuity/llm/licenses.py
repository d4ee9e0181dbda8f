"""Licences: known sentences become identifiers, ordered rules over them name the licence.

A text is cut into sentences twice: once with every line break as an end, once with lines
joined, so that both one-line notices and wrapped licence texts are seen whole. Sentences
are lower-cased, stripped of all but letters and digits, and looked up. The identifiers of
the known ones, in order, form a sequence. A known sentence that holds a sentence end itself
("SPDX-License-Identifier: MIT", "v. 2.0") is looked up as the run of pieces that the cutting
makes of it. Rules are tried in their order; one that fits
takes its identifiers out, so that a longer licence is not reported as its shorter kin too.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acuity.llm.common import texts

# Sentences of public licences and notices, by identifier.
SENTENCES = {
    "mit-ref": ["Released under the MIT License", "Licensed under the MIT License",
                "This project is licensed under the MIT License", "The MIT License (MIT)",
                "MIT License", "License: MIT", "SPDX-License-Identifier: MIT"],
    "mit-grant": ['Permission is hereby granted, free of charge, to any person obtaining a copy of '
                  'this software and associated documentation files (the "Software"), to deal in '
                  'the Software without restriction, including without limitation the rights to '
                  'use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies '
                  'of the Software, and to permit persons to whom the Software is furnished to do '
                  'so, subject to the following conditions:'],
    "mit-notice": ["The above copyright notice and this permission notice shall be included in all "
                   "copies or substantial portions of the Software."],
    "mit-asis": ['THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR '
                 'IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS '
                 'FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.'],
    "apache2-ref": ["Licensed under the Apache License, Version 2.0",
                    'Licensed under the Apache License, Version 2.0 (the "License")',
                    "Released under the Apache License, Version 2.0",
                    "Apache License, Version 2.0", "License: Apache-2.0",
                    "SPDX-License-Identifier: Apache-2.0"],
    "apache2-comply": ["you may not use this file except in compliance with the License."],
    "apache2-asis": ['Unless required by applicable law or agreed to in writing, software '
                     'distributed under the License is distributed on an "AS IS" BASIS, WITHOUT '
                     'WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'],
    "gpl3-ref": ["This work is licensed under the GNU General Public License, version 3",
                 "Licensed under the GNU General Public License, version 3",
                 "Released under the GNU General Public License, version 3",
                 "SPDX-License-Identifier: GPL-3.0-only", "License: GPL-3.0"],
    "gpl3-title": ["GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "gpl-free": ["This program is free software: you can redistribute it and/or modify it under the "
                 "terms of the GNU General Public License as published by the Free Software "
                 "Foundation, either version 3 of the License, or (at your option) any later "
                 "version."],
    "gpl2-ref": ["Licensed under the GNU General Public License, version 2",
                 "SPDX-License-Identifier: GPL-2.0-only", "License: GPL-2.0"],
    "lgpl-ref": ["Licensed under the GNU Lesser General Public License, version 3",
                 "SPDX-License-Identifier: LGPL-3.0-only"],
    "agpl-ref": ["Licensed under the GNU Affero General Public License, version 3",
                 "SPDX-License-Identifier: AGPL-3.0-only"],
    "mpl2-ref": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
                 "Licensed under the Mozilla Public License, version 2.0",
                 "SPDX-License-Identifier: MPL-2.0"],
    "bsd-grant": ["Redistribution and use in source and binary forms, with or without modification, "
                  "are permitted provided that the following conditions are met:"],
    "bsd-source": ["Redistributions of source code must retain the above copyright notice, this list "
                   "of conditions and the following disclaimer."],
    "bsd-binary": ["Redistributions in binary form must reproduce the above copyright notice, this "
                   "list of conditions and the following disclaimer in the documentation and/or "
                   "other materials provided with the distribution."],
    "bsd-endorse": ["Neither the name of the copyright holder nor the names of its contributors may be "
                    "used to endorse or promote products derived from this software without specific "
                    "prior written permission."],
    "bsd3-ref": ["Licensed under the BSD 3-Clause License", "SPDX-License-Identifier: BSD-3-Clause"],
    "bsd2-ref": ["Licensed under the BSD 2-Clause License", "SPDX-License-Identifier: BSD-2-Clause"],
    "isc-grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose "
                  "with or without fee is hereby granted, provided that the above copyright notice "
                  "and this permission notice appear in all copies."],
    "isc-ref": ["Licensed under the ISC License", "SPDX-License-Identifier: ISC"],
    "unlicense": ["This is free and unencumbered software released into the public domain."],
    "ccbync4-ref": ["Licensed under CC BY-NC 4.0", "Released under CC BY-NC 4.0",
                    "This work is licensed under CC BY-NC 4.0",
                    "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 "
                    "International License."],
    "ccby4-ref": ["Licensed under CC BY 4.0", "This work is licensed under CC BY 4.0",
                  "This work is licensed under a Creative Commons Attribution 4.0 International "
                  "License."],
    "ccbysa4-ref": ["Licensed under CC BY-SA 4.0", "This work is licensed under CC BY-SA 4.0"],
    "cc0-ref": ["Licensed under CC0 1.0", "This work is dedicated to the public domain under CC0 1.0"],
}

# Licence and the sentences it needs, in order; tried from first to last.
RULES = [
    ("MIT", ["mit-grant", "mit-notice", "mit-asis"]),
    ("MIT", ["mit-grant", "mit-notice"]),
    ("Apache-2.0", ["apache2-ref", "apache2-comply", "apache2-asis"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("GPL-3.0-or-later", ["gpl-free"]),
    ("GPL-3.0", ["gpl3-title"]), ("GPL-3.0", ["gpl3-ref"]), ("GPL-2.0", ["gpl2-ref"]),
    ("LGPL-3.0", ["lgpl-ref"]), ("AGPL-3.0", ["agpl-ref"]), ("MPL-2.0", ["mpl2-ref"]),
    ("ISC", ["isc-grant"]), ("ISC", ["isc-ref"]),
    ("MIT", ["mit-ref"]), ("Apache-2.0", ["apache2-ref"]),
    ("BSD-3-Clause", ["bsd3-ref"]), ("BSD-2-Clause", ["bsd2-ref"]),
    ("Unlicense", ["unlicense"]), ("CC-BY-NC-4.0", ["ccbync4-ref"]),
    ("CC-BY-SA-4.0", ["ccbysa4-ref"]), ("CC-BY-4.0", ["ccby4-ref"]), ("CC0-1.0", ["cc0-ref"]),
]

#: Every known sentence holds one of these, so other texts need no cutting.
GATE = "licen[sc]|permission|permitted|redistribut|warrant|copyright|domain|released"
ENDS = {"lines": r"[.!?;:]+[ \t\r]+|[.!?;:]*[\n]+", "joined": r"[.!?;:]+[ \t\r\n]+|[\n][ \t\r]*[\n]"}


def normalise(sentence: str) -> str:
    return re.sub("[^a-z0-9]+", " ", sentence.lower()).strip()


def known() -> dict[str, str]:
    """Normalised sentence to identifier."""
    return {normalise(s): name for name, group in SENTENCES.items() for s in group}


def in_pieces() -> dict[int, dict[str, str]]:
    """Known sentences that a cutting takes apart, by the number of pieces."""
    out: dict[int, dict[str, str]] = {}
    for name, group in SENTENCES.items():
        for s in group:
            for ends in ENDS.values():
                n = sum(1 for piece in re.split(ends, s) if normalise(piece))
                if n > 1:
                    out.setdefault(n, {})[normalise(s)] = name
    return out


def patterns() -> list[tuple[str, str]]:
    """Each rule as an expression over the sequence of identifiers; others may stand between."""
    return [(name, " " + "[a-z0-9 -]*? ".join(ids) + " ") for name, ids in RULES]


def find_licenses(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``sentence_ids`` (of known sentences, in order) and ``licenses``.

    ``licenses`` is an array of licence names without repeats, in rule order; both are empty
    where nothing is known. A null text counts as empty; rows may repeat and doc_id may be
    null, each row is judged by itself. Columns other than doc_id and text are ignored.
    """
    as_map = lambda d: F.create_map(*[F.lit(x) for pair in d.items() for x in pair])
    table, runs = as_map(known()), {n: as_map(d) for n, d in sorted(in_pieces().items())}
    rules = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(p).alias("pattern"))
                      for n, p in patterns()])
    none = F.array().cast("array<string>")
    gate = F.col("text").rlike(f"(?i){GATE}")
    rows = texts(docs).withColumns({
        way: F.when(gate, F.transform(
            F.split("text", ends, -1),
            lambda s: F.trim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", " ")),
        )).otherwise(none)
        for way, ends in ENDS.items()
    })

    def lookup(way):
        return lambda s, k: F.coalesce(F.try_element_at(table, s), *[
            F.try_element_at(m, F.array_join(F.slice(way, k + 1, n), " ")) for n, m in runs.items()
        ])

    rows = rows.withColumns({
        way: F.filter(F.transform(way, lookup(way)), lambda i: i.isNotNull()) for way in ENDS
    })

    def fold(way):
        # identifiers stand between double blanks, so that neighbours do not share one
        start = F.struct(
            F.concat(F.lit(" "), F.array_join(way, "  "), F.lit(" ")).alias("rest"),
            none.alias("found"),
        )
        return F.aggregate(rules, start, lambda a, r: F.when(
            F.rlike(a["rest"], r["pattern"]),
            F.struct(F.regexp_replace(a["rest"], r["pattern"], F.lit(" ")).alias("rest"),
                     F.array_append(a["found"], r["name"]).alias("found")),
        ).otherwise(a), lambda a: a["found"])

    some = (F.size("lines") > 0) | (F.size("joined") > 0)
    found = F.array_distinct(F.concat(fold("joined"), fold("lines")))
    order = F.array(*[F.lit(n) for n in dict.fromkeys(n for n, _ in RULES)])
    return rows.select(
        "doc_id",
        F.when(F.size("joined") >= F.size("lines"), F.col("joined"))
        .otherwise(F.col("lines")).alias("sentence_ids"),
        F.when(some, F.filter(order, lambda n: F.array_contains(found, n)))
        .otherwise(none).alias("licenses"),
    )


def license_rows(docs: DataFrame) -> DataFrame:
    """The result with both arrays as comma-joined text, and the number of known sentences."""
    return find_licenses(docs).select(
        "doc_id",
        F.size("sentence_ids").cast("long").alias("n_sentences"),
        F.array_join("sentence_ids", ",").alias("sentence_ids"),
        F.array_join("licenses", ",").alias("licenses"),
    )


def oracle() -> str:
    """The same as one SQL statement for DuckDB, but for the sentences of ``in_pieces``."""
    text = lambda s: "'" + s.replace("'", "''") + "'"
    pairs = ", ".join(f"({text(s)}, '{i}')" for s, i in known().items())
    parts, rules = [], patterns()
    for way, ends in ENDS.items():
        parts.append(f"""
        {way}_ids AS (
          SELECT r, list(k.id ORDER BY s.at) AS ids FROM (
            SELECT r, unnest(string_split_regex(text, '{ends}')) AS raw,
                   generate_subscripts(string_split_regex(text, '{ends}'), 1) AS at FROM d
          ) s JOIN known k ON k.sentence = trim(regexp_replace(lower(s.raw), '[^a-z0-9]+', ' ', 'g'))
          GROUP BY r)""")
        seq = f"' ' || array_to_string(coalesce({way}_ids.ids, []), '  ') || ' '"
        parts.append(f"{way}_0 AS (SELECT d.r, {seq} AS rest, '' AS found "
                     f"FROM d LEFT JOIN {way}_ids USING (r))")
        for k, (name, p) in enumerate(rules):
            parts.append(
                f"{way}_{k + 1} AS (SELECT r, CASE WHEN regexp_matches(rest, '{p}') THEN "
                f"regexp_replace(rest, '{p}', ' ', 'g') ELSE rest END AS rest, "
                f"CASE WHEN regexp_matches(rest, '{p}') THEN found || ',{name},' ELSE found END "
                f"AS found FROM {way}_{k})"
            )
    names = list(dict.fromkeys(n for n, _ in rules))
    kept = ", ".join(f"CASE WHEN contains(l.found || j.found, ',{n},') THEN '{n}' END" for n in names)
    last = len(rules)
    return f"""
      WITH known(sentence, id) AS (VALUES {pairs}),
      d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
      {", ".join(parts)}
      SELECT d.doc_id,
        cast(len(i.ids) AS BIGINT) AS n_sentences,
        array_to_string(i.ids, ',') AS sentence_ids,
        coalesce(array_to_string(list_filter([{kept}], lambda x: x IS NOT NULL), ','), '') AS licenses
      FROM d JOIN lines_{last} l USING (r) JOIN joined_{last} j USING (r)
      JOIN (SELECT d.r, CASE WHEN len(coalesce(b.ids, [])) >= len(coalesce(a.ids, []))
                   THEN coalesce(b.ids, []) ELSE a.ids END AS ids
            FROM d LEFT JOIN lines_ids a USING (r) LEFT JOIN joined_ids b USING (r)) i USING (r)"""
