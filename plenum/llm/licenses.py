"""Licence scans by sentence rules, in column expressions only.

A text is cut into sentences, each normalised to lower-case words of letters and digits, and mapped to the identifier of a known licence
sentence. The identifiers in their order are matched against licence rules: sequences of identifiers, between which other sentences may
stand. A text is cut twice, as its lines are and with the lines of a paragraph joined, as licence texts are often wrapped.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences of public licences and of usual licence statements, by identifier.
SENTENCES = {
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-warranty": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    "mit-liability": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "mit-released": "Released under the MIT License.",
    "mit-licensed": "Licensed under the MIT License.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "apache-licensed": 'Licensed under the Apache License, Version 2.0 (the "License");',
    "apache-compliance": "you may not use this file except in compliance with the License.",
    "apache-copy": "You may obtain a copy of the License at",
    "apache-statement": "Licensed under the Apache License, Version 2.0.",
    "gpl-free": "This program is free software:",
    "gpl-terms-3": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-terms-2": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl-statement-3": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-statement-2": "This work is licensed under the GNU General Public License, version 2.",
    "mpl-subject": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "cc-by": "Licensed under CC BY 4.0.",
    "cc-by-sa": "Licensed under CC BY-SA 4.0.",
    "cc-by-nc": "Licensed under CC BY-NC 4.0.",
    "cc-by-long": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-long": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc-by-nc-long": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "cc0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "reserved": "All rights reserved.",
}

#: (licence, identifiers in order); a licence may have several rules.
RULES = (
    ("MIT", ("mit-grant", "mit-notice", "mit-warranty", "mit-liability")),
    ("MIT", ("mit-released",)),
    ("MIT", ("mit-licensed",)),
    ("ISC", ("isc-grant",)),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("Apache-2.0", ("apache-licensed", "apache-compliance", "apache-copy")),
    ("Apache-2.0", ("apache-statement",)),
    ("GPL-3.0", ("gpl-free", "gpl-terms-3")),
    ("GPL-3.0", ("gpl-statement-3",)),
    ("GPL-2.0", ("gpl-free", "gpl-terms-2")),
    ("GPL-2.0", ("gpl-statement-2",)),
    ("MPL-2.0", ("mpl-subject",)),
    ("CC-BY-4.0", ("cc-by",)),
    ("CC-BY-4.0", ("cc-by-long",)),
    ("CC-BY-SA-4.0", ("cc-by-sa",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-long",)),
    ("CC-BY-NC-4.0", ("cc-by-nc",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-long",)),
    ("CC0-1.0", ("cc0",)),
    ("Unlicense", ("unlicense",)),
    ("All-rights-reserved", ("reserved",)),
)

_END = r"([.!?;:])[ \t\r\n]+"
_PARAGRAPH = r"\n[ \t\r]*\n"


def normalised(sentence: str) -> str:
    return re.sub("[^a-z0-9]+", " ", sentence.lower()).strip()


def known_sentences() -> dict[str, str]:
    """Normalised sentence to identifier. A sentence with ends inside is known by each of its parts together, so it is cut as texts are."""
    out = {}
    for name, text in SENTENCES.items():
        parts = [normalised(p) for p in re.sub(_END, r"\1\n", text).split("\n")]
        for i, part in enumerate(p for p in parts if p):
            out.setdefault(part, name if i == 0 else f"{name}-{i + 1}")
    return out


KNOWN = known_sentences()


def _steps(names: tuple[str, ...]) -> list[str]:
    """The identifiers of a rule, with those of the parts of sentences that are cut."""
    steps = []
    for name in names:
        parts = [normalised(p) for p in re.sub(_END, r"\1\n", SENTENCES[name]).split("\n")]
        steps += [KNOWN[p] for p in parts if p]
    return steps


def rule_pattern(names: tuple[str, ...]) -> str:
    return "(^| )" + "( | .* )".join(map(re.escape, _steps(names))).replace("\\-", "-") + "( |$)"


def sentences(text: Column, joined: bool) -> Column:
    """The normalised sentences of a text in order; `joined`: the lines of a paragraph are one."""
    if joined:
        text = F.translate(F.regexp_replace(text, _PARAGRAPH, "\x01"), "\n", " ")
    ended = F.regexp_replace(text, _END, "$1\x01")
    parts = F.split(ended if joined else F.translate(ended, "\n", "\x01"), "\x01", -1)
    plain = F.transform(parts, lambda s: F.trim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", " ")))
    return F.filter(plain, lambda s: s != "")


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES) -> DataFrame:
    """(`id_col`, n_sentences, sentence_ids, licenses) for every row of `docs`.

    sentence_ids: identifiers of the known sentences in order, of lines as they are and, where that finds more, of joined lines; licenses: the
    licences with a rule that either sequence follows, by name. Null and empty texts have no sentences; repeated rows come out as often
    as they came in; an empty table gives an empty table. Other columns are not read.
    """
    table = F.create_map(*(F.lit(x) for pair in KNOWN.items() for x in pair))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    own = docs.select(F.col(id_col).alias(id_col), sentences(text, False).alias("_lines"), sentences(text, True).alias("_joined"))

    def known(column: str) -> Column:
        return F.filter(F.transform(column, lambda s: F.try_element_at(table, s)), lambda x: x.isNotNull())

    found = own.select(id_col, F.size("_lines").cast("long").alias("n_sentences"), known("_lines").alias("_a"), known("_joined").alias("_b"))
    text_of = found.withColumns({"_sa": F.array_join("_a", " "), "_sb": F.array_join("_b", " ")})
    names = [F.when(F.col("_sa").rlike(rule_pattern(r)) | F.col("_sb").rlike(rule_pattern(r)), F.lit(name)) for name, r in rules]
    licenses = F.array_sort(F.array_distinct(F.filter(F.array(*names), lambda x: x.isNotNull())))
    return text_of.select(id_col, "n_sentences", F.when(F.size("_b") > F.size("_a"), F.col("_b")).otherwise(F.col("_a")).alias("sentence_ids"), licenses.alias("licenses"))


def _oracle() -> str:
    def quoted(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    known = ", ".join(f"({quoted(k)}, {quoted(v)})" for k, v in KNOWN.items())
    rules = ", ".join(f"({quoted(n)}, {quoted(rule_pattern(r))})" for n, r in RULES)
    return f"""
WITH known(sentence, name) AS (VALUES {known}), rules(license, pattern) AS (VALUES {rules}),
ended AS (
  SELECT doc_id, way, unnest(parts) AS part, unnest(range(len(parts))) AS i FROM (
    SELECT doc_id, 'a' AS way, string_split(translate(regexp_replace(coalesce(text, ''), '{_END}', '\\1' || chr(1), 'g'), chr(10), chr(1)), chr(1)) AS parts FROM documents
    UNION ALL
    SELECT doc_id, 'b', string_split(regexp_replace(translate(regexp_replace(coalesce(text, ''), '{_PARAGRAPH}', chr(1), 'g'), chr(10), ' '), '{_END}', '\\1' || chr(1), 'g'), chr(1))
    FROM documents
  )
), plain AS (SELECT doc_id, way, i, trim(regexp_replace(lower(part), '[^a-z0-9]+', ' ', 'g')) AS sentence FROM ended),
runs AS (
  SELECT doc_id, way, count(*) FILTER (WHERE p.sentence <> '') AS n, count(k.name) AS m, coalesce(string_agg(k.name, ' ' ORDER BY i), '') AS ids
  FROM plain p LEFT JOIN known k ON p.sentence = k.sentence GROUP BY doc_id, way
), found AS (SELECT doc_id, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses FROM runs JOIN rules ON regexp_matches(ids, pattern) GROUP BY doc_id)
SELECT a.doc_id, a.n AS n_sentences, CASE WHEN b.m > a.m THEN b.ids ELSE a.ids END AS sentence_ids, coalesce(licenses, '') AS licenses
FROM (SELECT * FROM runs WHERE way = 'a') a JOIN (SELECT * FROM runs WHERE way = 'b') b USING (doc_id) LEFT JOIN found USING (doc_id)
"""


ORACLE = _oracle()
