"""License scans, in DataFrame functions only.

Units that speak of licences are compared with licence templates by the cosine of sparse TF-IDF vectors; a
file's licence is its best unit's. Units are lines and sentences, and with wrapped lines joined and comment marks
taken off: sentences, paragraphs and headers (runs of adjacent paragraphs), and of a file named as a licence
its whole text. Files without one inherit that of the licence file in the nearest ancestor directory, by joins on paths.

Frequencies are taken over the units of all files. Equal units are compared once, and their scores
joined back by hash; a shuffle never sees a text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewarden.llm._common import lower_ascii, written

THRESHOLD = 0.6
MENTION = r"(?i)licen[cs]|permission is hereby|permission to use|copyright|spdx|warrant|redistribut|public domain|all rights reserved|creative commons"
SENTENCE = r"\n+|(?<=[.!?;])\s+"
COMMENT = r"[ \t]*(?:/\*+|\*+/|\*+(?=\s|$)|//+|#+|;+|--+|%+|<!--+|\"\"\"|\'\'\')"
LICENSE_FILE = r"(?i)(^|/)(un)?(licen[cs]e|copying|notice)s?([.-][^/]*)?$"



def _gnu(kind: str, version: str, what: str = "program") -> str:
    """The notice that the GNU licences ask for at the head of each file."""
    return (
        f"This {what} is free software: you can redistribute it and/or modify it under the terms of the GNU {kind} as published by the Free Software Foundation, "
        f"either version {version} of the License, or (at your option) any later version. This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; "
        f"without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind} for more details. "
        f"You should have received a copy of the GNU {kind} along with this {what}. If not, see <https://www.gnu.org/licenses/>."
    )


def _title(kind: str, version: str, date: str, year: str) -> str:
    """The opening of a GNU licence file."""
    return (
        f"GNU {kind} Version {version}, {date} Copyright (C) {year} Free Software Foundation, Inc. "
        "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."
    )


_MIT_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
    "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
    "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
)
_MIT_NONE = (
    " THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE "
    "OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_NONE = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE "
    "ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS "
    "OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE "
    "OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_APACHE = (
    "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
    "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
    "See the License for the specific language governing permissions and limitations under the License."
)
_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
    "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
    "PERFORMANCE OF THIS SOFTWARE."
)

#: Short notices, file headers and licence files' texts or openings, by licence.
TEMPLATES = (
    ("MIT", _MIT_GRANT),
    ("MIT", "MIT License " + _MIT_GRANT + _MIT_NONE),
    ("Apache-2.0", _APACHE),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("GPL-2.0", _gnu("General Public License", "2")),
    ("GPL-2.0", _title("GENERAL PUBLIC LICENSE", "2", "June 1991", "1989, 1991")),
    ("GPL-3.0", _gnu("General Public License", "3")),
    ("GPL-3.0", _title("GENERAL PUBLIC LICENSE", "3", "29 June 2007", "2007")),
    ("LGPL-2.1", _gnu("Lesser General Public License", "2.1", "library")),
    ("LGPL-2.1", _title("LESSER GENERAL PUBLIC LICENSE", "2.1", "February 1999", "1991, 1999")),
    ("LGPL-3.0", _gnu("Lesser General Public License", "3", "library")),
    ("LGPL-3.0", _title("LESSER GENERAL PUBLIC LICENSE", "3", "29 June 2007", "2007")),
    ("AGPL-3.0", _gnu("Affero General Public License", "3")),
    ("AGPL-3.0", _title("AFFERO GENERAL PUBLIC LICENSE", "3", "19 November 2007", "2007")),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("BSD-2-Clause", _BSD + _BSD_NONE),
    ("BSD-3-Clause", _BSD + _BSD_THIRD + _BSD_NONE),
    ("ISC", _ISC),
    ("MIT", "Released under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("Apache-2.0", "you may not use this file except in compliance with the License"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0"),
    ("LGPL-2.1", "This library is licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted under the BSD 2-Clause License"),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products, under the BSD 3-Clause License"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, under the ISC License"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright under CC0 1.0 Universal"),
    ("Unlicense", "This is free and unencumbered software released into the public domain under the Unlicense."),
)


def terms(text: Column) -> Column:
    """Lower-case words and numbers, with inner points."""
    return F.filter(F.transform(F.split(lower_ascii(text), r"[^a-z0-9.]+"), lambda w: F.trim(w, F.lit("."))), lambda w: w != "")


def _frequencies(units: DataFrame, key: str) -> DataFrame:
    """(key, n, term, tf)"""
    return units.select(key, "n", F.explode(terms(F.col("unit"))).alias("term")).groupBy(key, "n", "term").agg(F.count("*").alias("tf"))


def _weighted(tf: DataFrame, idf: DataFrame, key: str) -> DataFrame:
    """(key, term, w): TF-IDF weights of unit length."""
    w = tf.join(idf, "term").select(key, "term", (F.col("tf") * F.col("idf")).alias("w"))
    norms = w.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return w.join(norms, key).select(key, "term", (F.col("w") / F.col("norm")).alias("w"))


def score_units(units: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(id, license, score) of distinct units (id, n: how often, unit); units under the threshold are left out."""
    spark = units.sparkSession
    templates = spark.createDataFrame([(i, name, 1, text) for i, (name, text) in enumerate(TEMPLATES)], "template int, license string, n long, unit string")
    own, known = written(_frequencies(units, "id"), "unit-terms"), _frequencies(templates.coalesce(1), "template")
    counts = own.groupBy("term").agg(F.sum("n").alias("df")).unionByName(known.groupBy("term").agg(F.sum("n").alias("df")))
    total = units.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] + len(TEMPLATES)
    idf = written(counts.groupBy("term").agg(F.sum("df").alias("df")).select("term", (F.log((1.0 + total) / (1.0 + F.col("df"))) + 1).alias("idf")), "idf")
    # The templates' vectors: a fixed list, so broadcasting them is bounded.
    vectors = _weighted(known, idf, "template").join(templates.select("template", "license"), "template").withColumnRenamed("w", "wt")
    dots = _weighted(own, idf, "id").join(F.broadcast(vectors), "term").groupBy("id", "license", "template").agg(F.sum(F.col("w") * F.col("wt")).alias("score"))
    # Rounded before they are compared: ties are not left to the order of a sum, and go to the smaller name.
    best = dots.groupBy("id").agg(F.min(F.struct((-F.round("score", 6)).alias("s"), F.concat(F.lit(""), "license").alias("license"))).alias("b"))
    return best.select("id", "b.license", (-F.col("b.s")).alias("score")).where(F.col("score") >= threshold)


def directory(path: Column) -> Column:
    return F.regexp_extract(path, r"(?s)^(.*)/[^/]*$", 1)


def ancestors(folder: Column) -> Column:
    """The folder, its parents and the root ('')."""
    parts = F.split(folder, "/")
    within = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    return F.array_distinct(F.concat(F.array(F.lit("")), within))


def _joined(text: Column) -> Column:
    """The paragraphs of a text, each on one line without comment marks; code and comment are never one paragraph."""
    apart = F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), rf"(?m)^({COMMENT}.*)\n(?!{COMMENT})", "$1\n\n")
    apart = F.regexp_replace(apart, rf"(?m)^(?!{COMMENT})(.+)\n(?={COMMENT})", "$1\n\n")
    bare = F.regexp_replace(F.regexp_replace(apart, rf"(?m)^{COMMENT}", ""), r"(?m)(?:\*+/|--+>)?[ \t]*$", "")
    return F.transform(F.split(bare, r"\n\s*\n"), lambda p: F.trim(F.regexp_replace(p, r"\s+", " ")))


def units_of(path: Column, text: Column) -> Column:
    """The units of a file that speak of licences, each once: see the head of this file."""
    text = F.coalesce(text, F.lit(""))
    paragraphs = _joined(text)
    runs = F.split(F.array_join(F.transform(paragraphs, lambda p: F.when(p.rlike(MENTION), p).otherwise(F.lit("\u0001"))), "\n"), "\u0001")
    headers = F.transform(runs, lambda r: F.trim(F.regexp_replace(r, r"\s+", " ")))
    sentences = F.flatten(F.transform(paragraphs, lambda p: F.split(p, SENTENCE)))
    whole = F.when(path.rlike(LICENSE_FILE), F.array(F.array_join(paragraphs, " "))).otherwise(F.array().cast("array<string>"))
    all_ = F.concat(F.split(text, SENTENCE), sentences, paragraphs, headers, whole)
    return F.array_distinct(F.filter(all_, lambda s: s.rlike(MENTION)))


def scan(files: DataFrame, *keep: str, threshold: float = THRESHOLD) -> DataFrame:
    """One row per file: keep, path, license, score, origin (header, file or inherited; else null), from_path.

    ``files`` has path, text and the columns to keep. A licence file is one named so, or whose licence
    sentences are at least half of its characters; its licence is that of its directory and below (of
    several the best scored, then the smaller path). Null and empty texts have no licence of their own;
    a null path lies in the root. Repeated files are judged alike.
    """
    held = files.select(*keep, F.coalesce("path", F.lit("")).alias("path"), "text", F.monotonically_increasing_id().alias("_file"))
    mentioned = F.filter(F.split(F.coalesce("text", F.lit("")), SENTENCE), lambda s: s.rlike(MENTION))
    none, speaks = F.array().cast("array<string>"), F.col("text").rlike(MENTION)
    found = written(
        held.select(*keep, "path", "_file", F.when(speaks, units_of(F.col("path"), F.col("text"))).otherwise(none).alias("_units"), F.when(speaks, mentioned).otherwise(none).alias("_lines"), F.length("text").alias("_size"))
        .withColumn("_own", F.col("path").rlike(LICENSE_FILE) | (F.coalesce(F.aggregate("_lines", F.lit(0), lambda a, s: a + F.length(s)), F.lit(0)) * 2 >= F.greatest("_size", F.lit(1)))),
        "files",
    )
    units = found.select("_file", F.explode("_units").alias("unit")).withColumn("id", F.xxhash64("unit"))
    distinct = written(units.groupBy("id").agg(F.count("*").alias("n"), F.min("unit").alias("unit")), "units")
    scores = written(score_units(distinct, threshold), "scores")
    own = written(units.drop("unit").join(scores, "id").groupBy("_file").agg(F.min(F.struct((-F.col("score")).alias("s"), "license")).alias("b")).select("_file", "b.license", (-F.col("b.s")).alias("score")), "own")
    judged = written(found.drop("_units", "_lines", "_size").join(own, "_file", "left"), "judged")

    in_folder = (
        judged.where("_own AND license IS NOT NULL")
        .groupBy(directory(F.col("path")).alias("folder"))
        .agg(F.min(F.struct((-F.col("score")).alias("s"), "path", "license")).alias("b"))
        .select("folder", F.col("b.license").alias("held"), F.col("b.path").alias("from_path"))
    )
    folders = judged.select(directory(F.col("path")).alias("_dir")).distinct().withColumn("folder", F.explode(ancestors(F.col("_dir"))))
    nearest = written(folders.join(in_folder, "folder").groupBy("_dir").agg(F.max_by(F.struct("held", "from_path"), F.length("folder")).alias("h")).select("_dir", "h.held", "h.from_path"), "nearest")
    placed = judged.withColumn("_folder", directory(F.col("path"))).join(nearest, F.col("_folder") == nearest["_dir"], "left")
    mine = F.col("license").isNotNull()
    return placed.select(
        *keep, "path", F.coalesce("license", "held").alias("license"), "score",
        F.when(mine & F.col("_own"), "file").when(mine, "header").when(F.col("held").isNotNull(), "inherited").alias("origin"),
        F.when(mine, F.col("path")).otherwise(F.col("from_path")).alias("from_path"),
    )
