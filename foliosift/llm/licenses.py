"""License scans by canonical digest.

A text, each of its blocks (between blank lines) and each of its lines is put in
canonical form: lower case, copyright lines and "all rights reserved" left out, equivalent
spellings made one, everything but letters and digits a single space. A copyright line has
a year or a sign after the word, behind the leader of a comment or not; a wrapped sentence
that goes on with "copyright holders" is none. Each line is put in form once; a block's form
is that of its lines, a text's that of its blocks. Units as long as a known form are hashed,
and their SHA-256 joined with the known ones, so only entire texts match. ``KNOWN`` are the
published texts in ``license_texts``, their usual headers and notices, and a line for
each SPDX identifier. Spellings that differ in punctuation alone are one: ``GPL-2.0+``
is told as GPL-2.0.

Defined results: null and empty texts, and units whose canonical form is empty, match
nothing; repeated rows each report; a unit that occurs more than once in a document
counts in ``n``; an empty table gives an empty result; only id and text are read.
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliosift.llm.common import table

# Public licence texts and notices, as published.
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
LICENSES = [
    ("MIT", MIT),
    ("MIT", "MIT License\n\n" + MIT),
    ("ISC", ISC),
    ("ISC", "ISC License\n\n" + ISC),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
]
TEXTS = Path(__file__).parent / "license_texts"
# Names that usual one-line notices use.
NAMES = {
    "MIT": ["MIT"], "ISC": ["ISC"], "BSD-2-Clause": ["BSD 2-Clause", "2-Clause BSD", "Simplified BSD", "BSD-2-Clause"],
    "BSD-3-Clause": ["BSD 3-Clause", "3-Clause BSD", "New BSD", "Modified BSD", "BSD-3-Clause"], "Apache-2.0": ["Apache", "Apache 2.0", "Apache-2.0"],
    "MPL-2.0": ["Mozilla Public", "MPL 2.0", "MPL-2.0"], "GPL-2.0": ["GPLv2", "GPL v2", "GPL-2.0"], "GPL-3.0": ["GPLv3", "GPL v3", "GPL-3.0"],
    "LGPL-2.1": ["LGPLv2.1", "LGPL v2.1", "LGPL-2.1"], "LGPL-3.0": ["LGPLv3", "LGPL v3", "LGPL-3.0"], "AGPL-3.0": ["AGPLv3", "AGPL v3", "AGPL-3.0"],
    "Unlicense": ["Unlicense"], "Zlib": ["zlib", "zlib/libpng"], "BSL-1.0": ["Boost Software", "Boost"],
}
CC = [f"BY{kind}" for kind in ("", "-SA", "-NC", "-ND", "-NC-SA", "-NC-ND")]
GNU = [("GPL", "General Public License", v) for v in ("2", "3")] + [("LGPL", "Lesser General Public License", v) for v in ("2.1", "3")] + [("AGPL", "Affero General Public License", "3")]


def _notices() -> list[tuple[str, str]]:
    out = []
    for name, spoken in NAMES.items():
        for s in spoken:
            for verb in ("Released", "Licensed", "Distributed"):
                out += [(name, f"{verb} under the {s} License."), (name, f"{verb} under {s}."), (name, f"This project is {verb.lower()} under the {s} License."), (name, f"This software is {verb.lower()} under the {s} License.")]
            out += [(name, f"License: {s}"), (name, f"This project is licensed under the terms of the {s} License.")]
    for kind in CC:
        for version in ("1.0", "2.0", "2.5", "3.0", "4.0"):
            name = f"CC-{kind}-{version}"
            out += [(name, f"{start} under CC {kind} {version}.") for start in ("Licensed", "Released", "This work is licensed", "This article is licensed")] + [(name, f"CC {kind} {version}")]
    for short, long, v in GNU:
        name = f"{short}-{v if '.' in v else v + '.0'}"
        for thing in ("program", "library", "file", "software"):
            for stop in (":", ";"):
                head = f"This {thing} is free software{stop} you can redistribute it and/or modify it under the terms of the GNU {long} as published by the Free Software Foundation"
                out += [(name, f"{head}, either version {v} of the License, or (at your option) any later version."), (name, f"{head}, version {v}."), (name, f"{head}; version {v} of the License.")]
        out += [(name, f"{start} licensed under the GNU {long}, version {v}.") for start in ("This work is", "This program is", "This software is")] + [(name, f"Licensed under the GNU {long}, version {v}."), (name, f"Licensed under the GNU {long} v{v}.")]
    apache = 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'
    copy = " You may obtain a copy of the License at\n\n    http{s}://www.apache.org/licenses/LICENSE-2.0"
    rest = 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'
    out += [("Apache-2.0", apache + copy.replace("{s}", s) + "\n\n" + rest) for s in ("", "s")] + [("Apache-2.0", apache + copy.partition("\n")[0])]
    mpl = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."
    return [*out, ("MPL-2.0", mpl), *(("MPL-2.0", f"{mpl} If a copy of the MPL was not distributed with this file, You can obtain one at {h}://mozilla.org/MPL/2.0/.") for h in ("http", "https"))]


def _published() -> list[tuple[str, str]]:
    """Texts as published and with each paragraph on a line, the BSD ones also after their usual lines."""
    out = []
    for f in sorted(TEXTS.glob("*.txt")):
        if f.stem == "spdx":
            continue
        name, text = f.stem.removesuffix("-UC"), f.read_text("utf-8")
        joined = "\n\n".join(" ".join(p.split()) for p in re.split(r"\n[ \t]*\n", text))
        for t in (text, joined):
            out.append((name, t))
            if name.startswith("BSD"):
                title = f"BSD {name[4]}-Clause License\n\n"
                out += [(name, title + t), (name, "All rights reserved.\n\n" + t), (name, title + "All rights reserved.\n\n" + t)]
            if name == "Zlib":
                out.append((name, "zlib License\n\n" + t))
    return out


def _all_known() -> list[tuple[str, str]]:
    """LICENSES and all others, whose form isn't yet there."""
    form = lambda t: re.sub(r"[\W_]+", " ", re.sub(f"(?im){COPYRIGHT}", " ", t).lower()).strip()
    spdx = [(i, f"SPDX-License-Identifier: {i}") for i in sorted((TEXTS / "spdx.txt").read_text("utf-8").split(), key=lambda i: (i.endswith("+"), i))]
    seen: dict[str, tuple[str, str]] = {}
    for name, text in [*LICENSES, *_notices(), *_published(), *spdx]:
        seen.setdefault(form(text), (name, text))
    return list(seen.values())


# Spellings held to be the same. Words that are also written apart are taken apart, so that lines can be put in form one by one.
SPELLINGS = [("licence", "license"), ("noncommercial", "non commercial"), ("sublicense", "sub license"), ("noninfringement", "non infringement"), ("organisation", "organization"), ("favour", "favor"), ("fulfilment", "fulfillment")]
LEADER = r"^[ \t]*(?:[#*;!%/-]+|dnl\b|rem\b|<!--)?[ \t/*#]*"
COPYRIGHT = LEADER + r"(?:copyright[ \t:]*(?:\(c\)|©|&copy;|[12][0-9][0-9][0-9]|<year|\[year|\[yyyy|\{yyyy)|\(c\)[ \t]*[12][0-9][0-9][0-9]|©|all rights reserved[. \t]*(?:\*/)?[ \t\r]*$)[^\n]*"
BLANK = r"\n[ \t\r]*\n"

KNOWN = _all_known()


def canonical(line: Column) -> Column:
    """The form of a line, or of a unit whose lines are all told apart by line feeds."""
    low = F.lower(line)
    # the pattern can only match where one of these is
    out = F.when(low.contains("copyright") | low.contains("(c)") | low.contains("©") | low.contains("rights reserved"), F.regexp_replace(low, f"(?imd){COPYRIGHT}", " ")).otherwise(low)
    out = F.trim(F.regexp_replace(out, r"[^\p{L}\p{N}]+", " "))
    for other, one in SPELLINGS:
        out = F.replace(out, F.lit(other), F.lit(one))
    return out


def known_digests(spark: SparkSession, licenses: list[tuple[str, str]]) -> DataFrame:
    known = spark.createDataFrame(licenses, "license string, known_text string").select("license", canonical(F.col("known_text")).alias("form"))
    return known.select("license", F.sha2("form", 256).alias("digest"), F.length("form").alias("length")).distinct()


def scan(docs: DataFrame, licenses: list[tuple[str, str]] = KNOWN, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, license, unit (text, block or line: the widest that matches), n (units that match)."""
    spark = docs.sparkSession
    # as many rows as the list has entries
    known = spark.createDataFrame(known_digests(spark, licenses).collect(), "license string, digest string, length int")
    lengths = [r[0] for r in known.select("length").distinct().collect()]
    blocks = F.transform(F.split(F.coalesce(F.col(text_column), F.lit("")), BLANK), lambda b: F.filter(F.transform(F.split(b, "\n"), canonical), lambda form: form != ""))
    forms = docs.select(F.col(id_column).alias("doc_id"), blocks.alias("lines"))
    forms = forms.select("doc_id", F.flatten("lines").alias("lines"), F.transform("lines", lambda b: F.array_join(b, " ")).alias("blocks"))
    whole = F.array(F.array_join(F.filter("blocks", lambda b: b != ""), " "))
    unit = lambda rank, parts: F.transform(F.filter(parts, lambda p: F.length(p).isin(lengths)), lambda p: F.struct(F.lit(rank).alias("rank"), p.alias("form")))
    units = F.concat(unit(0, whole), unit(1, F.col("blocks")), unit(2, F.col("lines")))
    parts = forms.select("doc_id", F.explode(units).alias("u")).select("doc_id", "u.rank", "u.form").where("form <> ''")
    digests = known.select("license", "digest")
    hits = parts.withColumn("digest", F.sha2("form", 256)).join(F.broadcast(digests) if len(licenses) <= 1_000_000 else digests, "digest")
    per = hits.groupBy("doc_id", "license", "rank").agg(F.count(F.lit(1)).alias("n")).groupBy("doc_id", "license")
    names = F.array(F.lit("text"), F.lit("block"), F.lit("line"))
    return per.agg(F.get(names, F.min("rank")).alias("unit"), F.max_by("n", "rank").alias("n"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    form = "regexp_replace(lower(coalesce({0}, '')), '(?im)" + COPYRIGHT + "', ' ', 'g')"
    form = "trim(regexp_replace(" + form + r", '[^\p{L}\p{N}]+', ' ', 'g'))"
    for other, one in SPELLINGS:
        form = f"replace({form}, '{other}', '{one}')"
    known = ", ".join(f"('{name}', '{text.replace(chr(39), chr(39) * 2)}')" for name, text in KNOWN)
    return f"""
WITH known AS (SELECT DISTINCT license, {form.replace('{0}', 't')} AS form FROM (VALUES {known}) AS k(license, t)),
units AS (
  SELECT doc_id, 0 AS rank, text AS part FROM documents
  UNION ALL SELECT doc_id, 1, unnest(regexp_split_to_array(coalesce(text, ''), '\\n[ \\t\\r]*\\n')) FROM documents
  UNION ALL SELECT doc_id, 2, unnest(string_split(coalesce(text, ''), chr(10))) FROM documents),
per AS (
  SELECT doc_id, license, rank, count(*) AS n
  FROM (SELECT doc_id, rank, {form.replace('{0}', 'part')} AS form FROM units) JOIN known USING (form) WHERE form <> '' GROUP BY ALL)
SELECT doc_id, license, CASE min(rank) WHEN 0 THEN 'text' WHEN 1 THEN 'block' ELSE 'line' END AS unit, arg_max(n, rank) AS n
FROM per GROUP BY doc_id, license"""


ORACLE = _oracle()
