"""License scan by canonical digests: whole texts and their lines, made canonical, are hash-joined with known license texts."""

from __future__ import annotations

from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.operators.skew import pin

#: Words that count as equal, and the one that stands for them.
EQUIVALENT = (
    ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("analyse", "analyze"), ("artefact", "artifact"),
    ("authorisation", "authorization"), ("authorised", "authorized"), ("calibre", "caliber"), ("cancelled", "canceled"),
    ("capitalisations", "capitalizations"), ("catalogue", "catalog"), ("categorise", "categorize"), ("centre", "center"),
    ("emphasised", "emphasized"), ("favour", "favor"), ("favourite", "favorite"), ("fulfil", "fulfill"),
    ("fulfilment", "fulfillment"), ("initialise", "initialize"), ("judgement", "judgment"), ("labelling", "labeling"),
    ("labour", "labor"), ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("maximise", "maximize"), ("modelled", "modeled"),
    ("modelling", "modeling"), ("offence", "offense"), ("optimise", "optimize"), ("organisation", "organization"),
    ("organise", "organize"), ("practise", "practice"), ("programme", "program"), ("realise", "realize"),
    ("recognise", "recognize"), ("signalling", "signaling"), ("sublicence", "sublicense"), ("utilisation", "utilization"),
    ("whilst", "while"), ("wilful", "willful"), ("noncommercial", "non commercial"), ("percent", "per cent"),
    ("sub license", "sublicense"), ("sub licensed", "sublicensed"), ("copyright owner", "copyright holder"), ("copyright owners", "copyright holders"),
    ("non infringement", "noninfringement"), ("merchantibility", "merchantability"), ("https", "http"),
)
#: A line of the canonical text that begins with one of these is a copyright line.
COPYRIGHT = r"(?m)^[\s*#/;%-]*(?:copyright|\(c\)|©|copr\.)[^\n]*$"

def whole_texts() -> tuple[tuple[str, str], ...]:
    """(id, text) of the texts in ``licenses``, each named by its license."""
    return tuple((f.stem, f.read_text(encoding="utf-8")) for f in sorted((Path(__file__).parent / "licenses").glob("*.txt")))


_PERMISSION = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
    "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
    "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
    "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS "
    "IN THE SOFTWARE."
)
_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted{notice}. "
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF "
    "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
    "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN "
    "CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
#: Titles that may lead a text whose file has none.
TITLES = {"BSD 2-Clause License": "BSD-2-Clause", "BSD 3-Clause License": "BSD-3-Clause", "The Unlicense": "Unlicense", "zlib License": "Zlib"}
#: Fixed values: (id, text) of known license texts and notices; a caller may pass more.
KNOWN = (
    ("MIT", _PERMISSION),
    ("MIT", "MIT License " + _PERMISSION),
    ("MIT", "The MIT License (MIT) " + _PERMISSION),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("ISC", _ISC.format(notice=", provided that the above copyright notice and this permission notice appear in all copies")),
    ("ISC", "ISC License " + _ISC.format(notice=", provided that the above copyright notice and this permission notice appear in all copies")),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("0BSD", _ISC.format(notice="")),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-2.0-only", "Licensed under the GNU General Public License, version 2."),
    ("GPL-2.0-only", "SPDX-License-Identifier: GPL-2.0-only"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
    *whole_texts(),
    *((i, f"{title} {t}") for title, own in TITLES.items() for i, t in whole_texts() if i == own),
)


def plain(text: Column) -> Column:
    """Lower case, without copyright lines, every run of other than letters and digits one space."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), COPYRIGHT, " "), r"[^\p{L}\p{N}]+", " "))


def spelled(text: Column) -> Column:
    """Equivalent words replaced by the one that stands for them; one test leaves texts without any as they are."""
    out = text
    for word, standard in EQUIVALENT:
        out = F.regexp_replace(out, rf"\b{word}\b", standard)
    return F.when(text.rlike(rf"\b(?:{'|'.join(word for word, _ in EQUIVALENT)})\b"), out).otherwise(text)


def scan_licenses(docs: DataFrame, known: Sequence[tuple[str, str]] = KNOWN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: ``doc_id, text_license, line_licenses, n_license_lines``.

    A unit is a whole text or one of its lines. Units made canonical (case, punctuation, copyright lines, equivalent
    spellings) are looked up by SHA-256 among the digests of ``known`` texts. ``text_license``: the license the whole text
    is; ``line_licenses``: distinct licenses its lines are, sorted, comma-joined; ``n_license_lines``: how many lines.

    ``known`` must fit in memory, as it comes from the caller's code. Units that spelling cannot bring to the length of
    a known text are not spelled out: each replaced word changes a length by at most two characters.

    Defined cases: null and empty texts hold nothing (empty strings, 0); of known texts with equal digests the least id
    counts; rows that share an id share what their texts hold together; null ids are such an id; no rows give no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    table = spark.createDataFrame([(i, t) for i, t in known], "license string, text string")
    table = table.select("license", spelled(plain(F.col("text"))).alias("unit"))
    longest = table.agg(F.max(F.length("unit"))).first()[0] or 0
    digests = table.groupBy(F.sha2("unit", 256).alias("digest")).agg(F.min("license").alias("license"))
    lines = F.transform(F.split("text", "\n"), lambda x: F.struct(F.lit(False).alias("whole"), x.alias("unit")))
    units = rows.select("doc_id", F.explode(F.concat(F.array(F.struct(F.lit(True).alias("whole"), F.col("text").alias("unit"))), lines)).alias("u"))
    units = pin(units.select("doc_id", "u.whole", "u.unit"), unit=plain(F.col("unit")))
    units = units.where((F.length("unit") > 0) & (F.length("unit") <= 2 * longest + 64))
    units = pin(units.select("doc_id", "whole", "unit"), digest=F.sha2(spelled(F.col("unit")), 256)).select("doc_id", "whole", "digest")
    found = units.join(F.broadcast(digests), "digest")
    held = found.groupBy("doc_id").agg(
        F.min(F.when(F.col("whole"), F.col("license"))).alias("text_license"),
        F.array_join(F.array_sort(F.collect_set(F.when(~F.col("whole"), F.col("license")))), ",").alias("line_licenses"),
        F.sum(F.when(F.col("whole"), 0).otherwise(1)).alias("n_license_lines"),
    ).withColumnRenamed("doc_id", "held_id")
    return rows.select("doc_id").join(held, F.col("doc_id").eqNullSafe(F.col("held_id")), "left").select(
        "doc_id", "text_license", F.coalesce("line_licenses", F.lit("")).alias("line_licenses"),
        F.coalesce("n_license_lines", F.lit(0)).cast("long").alias("n_license_lines"))
