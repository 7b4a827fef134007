"""License scans by sentence-rule recognition, with built-in functions only.

A text's sentences are normalised and mapped to the identifiers of known licence sentences.
A sentence begins and ends where a sentence or a line does, and may be wrapped over lines,
with comment marks before each. The text's sequence of identifiers is then matched against licence rules, each an ordered
sequence of identifiers that must follow one another with no other known sentence between.
Texts without any word that a known sentence must have are not split.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .line_dedup import LOWER, UPPER

#: Known licence sentences (fixed values: the wording of the licences).
SENTENCES = {
    "apache-notice": "Licensed under the Apache License, Version 2.0.",
    "apache-licensed": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "apache-copy": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "apache-as-is": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "apache-see": "See the License for the specific language governing permissions and limitations under the License.",
    "mit-notice": "Released under the MIT License.",
    "mit-licensed": "Licensed under the MIT License.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit-notice-kept": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-as-is": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "gpl3-notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "gpl-see": "See the GNU General Public License for more details.",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-names": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "mpl2-terms": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "cc-by-nc-4": "Licensed under CC BY-NC 4.0.",
    "cc-by-4": "Licensed under CC BY 4.0.",
    "cc-by-sa-4": "Licensed under CC BY-SA 4.0.",
    "cc-by-work": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}
#: Licence rules: what a sequence of known sentences says (fixed values).
RULES = {
    "Apache-2.0:notice": ["apache-notice"],
    "Apache-2.0:header": ["apache-licensed", "apache-copy", "apache-as-is", "apache-see"],
    "MIT:notice": ["mit-notice"],
    "MIT:licensed": ["mit-licensed"],
    "MIT:text": ["mit-grant", "mit-notice-kept", "mit-as-is"],
    "ISC:text": ["isc-grant"],
    "GPL-3.0:notice": ["gpl3-notice"],
    "GPL-3.0:header": ["gpl-free", "gpl-hope", "gpl-see"],
    "BSD-2-Clause:text": ["bsd-grant", "bsd-source", "bsd-binary"],
    "BSD-3-Clause:text": ["bsd-grant", "bsd-source", "bsd-binary", "bsd-names"],
    "MPL-2.0:header": ["mpl2-terms"],
    "CC-BY-NC-4.0:notice": ["cc-by-nc-4"],
    "CC-BY-4.0:notice": ["cc-by-4"],
    "CC-BY-SA-4.0:notice": ["cc-by-sa-4"],
    "CC-BY-4.0:work": ["cc-by-work"],
    "Unlicense:text": ["unlicense"],
}
#: Each known sentence has one of these in a word.
ANCHORS = ["licen", "software", "permission", "redistribut", "warrant"]
END, GAP = r"([.!?:;])[ \t\n\x0B\f\r]+", "[^a-z0-9]+"
#: What is between words, once ends of sentences are \x01: an end ".", a line break "|" or a blank.
#: Comment marks and empty lines go with the line break they follow.
MARKS = [("[^a-z0-9\n\x01]+", " "), (" ?\n[ \n]*", "|"), ("[ |]?\x01[ |\x01]*", ".")]


def normal(sentence: str) -> str:
    return re.sub(GAP, " ", sentence.lower()).strip()


def _known() -> dict[str, str]:
    """For the SQL, which has sentences of one part or the last part only: normalised sentence to
    identifier."""
    out: dict[str, str] = {}
    for name, text in SENTENCES.items():
        parts = [normal(x) for x in re.sub(END, "\\1\n", text).split("\n")]
        for i, x in enumerate(parts):
            assert i == 0 or any(a in x for a in ANCHORS) or any(a in normal(text) for a in ANCHORS)
            if i < len(parts) - 1:
                x = None  # a sentence of more parts is known by its last
            if x:
                assert out.setdefault(x, name) == name
    return out


def _whole() -> dict[str, str]:
    """Normalised sentence, with all its parts, to identifier."""
    return {normal(text): name for name, text in SENTENCES.items()}


def _pattern() -> str:
    """Known sentences, the longest first, from one end of a sentence or line to another; lines
    may break between any two words. Ends within a known sentence (as after "v.") belong to it."""
    parts = [[normal(x).replace(" ", "[ |]") for x in re.sub(END, "\\1\n", text).split("\n")] for text in SENTENCES.values()]
    known = sorted(("[ |.]".join(x) for x in parts), key=lambda x: (-len(x), x))
    return "(?<=[|.])(?:" + "|".join(known) + ")(?=[|.])"


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row: ``doc_id``, ``sentences`` (identifiers of known sentences in
    order) and ``licenses`` (names of the rules that match, sorted).

    A rule that is part of a longer matching rule of the same sequence is reported too. Null or empty texts have none. Other columns are not read.
    """
    known = F.create_map(*[F.lit(x) for pair in _whole().items() for x in pair])
    low = F.lower(F.col("text"))
    may = F.lit(False)
    for a in ANCHORS:
        may = may | low.contains(a)
    parts = F.regexp_replace(F.translate(F.col("text"), UPPER + "\x01", LOWER + "_"), END, "$1\x01")
    for pattern, mark in MARKS:
        parts = F.regexp_replace(parts, pattern, mark)
    parts = F.concat(F.lit("|"), F.btrim(parts, F.lit(" |.")), F.lit("|"))
    found = F.transform(F.regexp_extract_all(parts, F.lit(_pattern()), F.lit(0)), lambda s: F.element_at(known, F.translate(s, "|.", "  ")))
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    out = base.select("doc_id", F.when(may, found).otherwise(F.array().cast("array<string>")).alias("sentences"))
    sequence = F.concat(F.lit(" "), F.array_join("sentences", " "), F.lit(" "))
    rules = [F.when(F.col("sequence").contains(" " + " ".join(r) + " "), F.lit(n)) for n, r in sorted(RULES.items())]
    out = out.withColumn("sequence", sequence)
    matched = F.when(F.size("sentences") > 0, F.filter(F.array(*rules), lambda x: x.isNotNull())).otherwise(F.array().cast("array<string>"))
    return out.select("doc_id", "sentences", matched.alias("licenses"))


def query(spark, sf_dir: str) -> DataFrame:
    out = scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.size("sentences").cast("long").alias("n_sentences"), F.array_join("sentences", ",").alias("sentence_ids"), F.array_join("licenses", ",").alias("license_ids"))


def _sql() -> str:
    def text(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    known = ", ".join(f"({text(a)}, {text(b)})" for a, b in _known().items())
    rules = ", ".join(f"({text(n)}, {text(' ' + ' '.join(r) + ' ')})" for n, r in RULES.items())
    return f"""
WITH known(sentence, id) AS (VALUES {known}), rules(name, seq) AS (VALUES {rules}),
base AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS text FROM documents),
split AS (SELECT doc_id, string_split(regexp_replace(text, '([.!?:;])[ \\t\\n\\x0B\\f\\r]+', '\\1' || chr(10), 'g'), chr(10)) AS parts FROM base),
part AS (SELECT doc_id, unnest(parts) AS part, generate_subscripts(parts, 1) AS pos FROM split),
seq AS (SELECT p.doc_id, count(*) AS n, string_agg(k.id, ',' ORDER BY pos) AS ids, ' ' || string_agg(k.id, ' ' ORDER BY pos) || ' ' AS seq
    FROM part p JOIN known k ON trim(regexp_replace(p.part, '[^a-z0-9]+', ' ', 'g')) = k.sentence GROUP BY p.doc_id),
lic AS (SELECT s.doc_id, string_agg(r.name, ',' ORDER BY r.name) AS names FROM seq s JOIN rules r ON contains(s.seq, r.seq) GROUP BY s.doc_id)
SELECT d.doc_id, coalesce(s.n, 0) AS n_sentences, coalesce(s.ids, '') AS sentence_ids, coalesce(l.names, '') AS license_ids
FROM base d LEFT JOIN seq s ON d.doc_id = s.doc_id LEFT JOIN lic l ON d.doc_id = l.doc_id
"""


SQL = _sql()
