"""License scans by canonical digest, in DataFrame functions alone.

A text is made canonical (case, punctuation, copyright lines and equivalent spellings go) and hashed, and the hash is joined to the digests of known licence
texts and notices. Whole texts are looked up, and so are their paragraphs and lines, as licences are mostly found inside other texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, stored

# The wording of public licences, as their owners publish them.
MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"""
MIT_NOTICE = """The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."""
MIT_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC_GRANT = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"""
ISC_NOTICE = """, provided that the above copyright notice and this permission notice appear in all copies."""
ISC_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
BSD_WARRANTY = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
#: Licences named in short notices.
NAMES = {
    "MIT": ["the MIT License"],
    "Apache-2.0": ["the Apache License, Version 2.0", "Apache License 2.0"],
    "GPL-2.0-only": ["the GNU General Public License, version 2"],
    "GPL-3.0-only": ["the GNU General Public License, version 3"],
    "LGPL-3.0-only": ["the GNU Lesser General Public License, version 3"],
    "MPL-2.0": ["the Mozilla Public License, version 2.0"],
    "BSD-2-Clause": ["the BSD 2-Clause License"],
    "BSD-3-Clause": ["the BSD 3-Clause License"],
    "ISC": ["the ISC License"],
    "CC0-1.0": ["CC0 1.0"],
    "CC-BY-4.0": ["CC BY 4.0"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0"],
}
NOTICES = ["Licensed under {}.", "Released under {}.", "This work is licensed under {}.", "This software is licensed under {}.", "Distributed under {}."]


def known_licenses() -> list[tuple[str, str]]:
    """(license_id, wording): full texts, short notices, and identifier lines."""
    full = {
        "MIT": f"{MIT_GRANT}\n\n{MIT_NOTICE}\n\n{MIT_WARRANTY}",
        "ISC": f"{ISC_GRANT}{ISC_NOTICE}\n\n{ISC_WARRANTY}",
        "0BSD": f"{ISC_GRANT}.\n\n{ISC_WARRANTY}",
        "BSD-2-Clause": BSD_HEAD + BSD_WARRANTY,
        "BSD-3-Clause": BSD_HEAD + BSD_THIRD + BSD_WARRANTY,
        "Zlib": ZLIB,
    }
    titles = {"MIT": "MIT License", "ISC": "ISC License", "0BSD": "BSD Zero Clause License", "BSD-2-Clause": "BSD 2-Clause License", "BSD-3-Clause": "BSD 3-Clause License", "Zlib": "zlib License"}
    out = [*full.items(), *((k, f"{titles[k]}\n\n{v}") for k, v in full.items())]
    out += [(k, notice.format(name)) for k, names in NAMES.items() for name in names for notice in NOTICES]
    return out + [(k, f"SPDX-License-Identifier: {k}") for k in [*full, *NAMES]]


#: Pieces of full texts, each of which may be a paragraph of its own.
PIECES = {
    "MIT": [MIT_GRANT, MIT_NOTICE, MIT_WARRANTY],
    "ISC": [ISC_GRANT + ISC_NOTICE, ISC_WARRANTY],
    "0BSD": [ISC_GRANT + ".", ISC_WARRANTY],
    "BSD-2-Clause": [*BSD_HEAD.strip().split("\n"), BSD_WARRANTY],
    "BSD-3-Clause": [*BSD_HEAD.strip().split("\n"), BSD_THIRD, BSD_WARRANTY],
    "Zlib": ZLIB.split("\n"),
}
GPL_NOTE = "This {0} is free software: you can redistribute it and/or modify it under the terms of the GNU {1} as published by the Free Software Foundation, either version {2} of the License, or (at your option) any later version."
GPL_ONLY = "This {0} is free software: you can redistribute it and/or modify it under the terms of the GNU {1} as published by the Free Software Foundation, version {2} of the License."
GPL_WARRANTY = "This {0} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {1} for more details."
GPL_COPY = "You should have received a copy of the GNU {1} along with this {0}. If not, see <{3}://www.gnu.org/licenses/>."
GPL_KINDS = [("GPL-2.0", "General Public License", "2"), ("GPL-3.0", "General Public License", "3"), ("LGPL-2.1", "Lesser General Public License", "2.1"), ("LGPL-3.0", "Lesser General Public License", "3"), ("AGPL-3.0", "Affero General Public License", "3")]


def known_runs() -> list[tuple[str, list[str]]]:
    """(license_id, paragraphs): full texts in every cut into two paragraphs or more, and the standard headers of other licences, by the paragraph that names them."""
    out = []
    for name, pieces in PIECES.items():
        for cuts in range(1, 1 << (len(pieces) - 1)):
            run = [pieces[0]]
            for i, piece in enumerate(pieces[1:]):
                run = [*run, piece] if cuts >> i & 1 else [*run[:-1], f"{run[-1]}\n{piece}"]
            out.append((name, run))
    apache = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"""
    terms = """Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
    headers = [("Apache-2.0", apache)]
    for web in ("http", "https"):
        where = f"{apache} {web}://www.apache.org/licenses/LICENSE-2.0"
        headers += [("Apache-2.0", where), ("Apache-2.0", f"{where} {terms}")]
        mpl = f"This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at {web}://mozilla.org/MPL/2.0/."
        cc0 = "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty."
        copy = f"You should have received a copy of the CC0 Public Domain Dedication along with this software. If not, see <{web}://creativecommons.org/publicdomain/zero/1.0/>."
        headers += [("MPL-2.0", mpl), ("CC0-1.0", copy), ("CC0-1.0", f"{cc0} {copy}")]
    for name, title, version in GPL_KINDS:
        for what in ("program", "library", "software"):
            for note, suffix in ((GPL_NOTE, "or-later"), (GPL_ONLY, "only")):
                words = (what, title, version)
                first, second = note.format(*words), GPL_WARRANTY.format(*words)
                headers += [(f"{name}-{suffix}", w) for w in (first, f"{first} {second}")]
                headers += [(f"{name}-{suffix}", f"{first} {second} {GPL_COPY.format(*words, web)}") for web in ("http", "https")]
    return out + [(name, [wording]) for name, wording in headers]


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What goes, in this order, from a text in lower case (Java's and RE2's common notation).
RULES = (
    (r"(?m)^[^a-z0-9\n]*(copyright|\(c\)|©)[^\n]*$", " "),
    (r"(?m)^[^a-z0-9\n]*all rights reserved[^a-z0-9\n]*$", " "),
    (r"[^a-z0-9\x{80}-\x{10FFFF}]+", " "),
    (r"\blicence", "license"),
    (r"\b(non|sub) ?(commercial|infringement|license)", "$1$2"),
    (r"\backnowledgement", "acknowledgment"),
    (r"\bcopyright owner", "copyright holder"),
    (r"\bv(er)?(sion)? ?([0-9])", "version $3"),
    (r"\borganisation", "organization"),
    (r"^ +| +$", ""),
)


#: Every known wording has one of these, and no rule takes them away: a part without any is not a known wording and needs no further work.
ANCHORS = ("licen", "permi", "software", "distributed", "released")


def may_be_known(text: Column, anchors: tuple[str, ...]) -> Column:
    lowered = F.lower(text)
    found = F.lit(False)
    for anchor in anchors:
        found = found | F.contains(lowered, F.lit(anchor))
    return found


def canonical(text: Column) -> Column:
    """A text without case, punctuation and copyright lines, in one spelling, one space between words."""
    out = F.translate(text, UPPER, LOWER)
    for pattern, with_ in RULES:
        out = F.regexp_replace(out, pattern, with_)
    return out


def digests(spark: SparkSession, known: list[tuple[str, str]] | None = None) -> DataFrame:
    """digest, license_id, size of the known wordings: a fixed table. Wordings that are one when canonical have the first id."""
    rows = spark.createDataFrame([(i, *r) for i, r in enumerate(known or known_licenses())], "n int, license_id string, wording string")
    made = rows.select("n", "license_id", canonical(F.col("wording")).alias("c")).groupBy(F.sha2("c", 256).alias("digest"), F.length("c").alias("size"))
    return made.agg(F.min_by("license_id", "n").alias("license_id"))


#: Every run has one of these words in its text, and every paragraph of one has one of RUN_ANCHORS.
RUN_WORDS = ("permission", "redistribution", "apache", "gnu", "mozilla", "cc0")
RUN_ANCHORS = (*ANCHORS, "distribution")


def runs(spark: SparkSession) -> DataFrame:
    """run (the digests of its paragraphs, joined), license_id of the known runs: a fixed table."""
    rows = [(n, name, i, part) for n, (name, run) in enumerate(known_runs()) for i, part in enumerate(run)]
    made = spark.createDataFrame(rows, "n int, license_id string, i int, wording string").withColumn("digest", F.sha2(canonical(F.col("wording")), 256))
    made = made.groupBy("n", "license_id").agg(F.array_sort(F.collect_list(F.struct("i", "digest"))).alias("parts"))
    return made.select("license_id", F.concat_ws("", F.transform("parts", lambda p: F.concat(F.lit("<"), p["digest"], F.lit(">")))).alias("run")).groupBy("run").agg(F.min("license_id").alias("license_id"))


def paragraph_digests(text: Column) -> Column:
    """The digests of all paragraphs of a text in order, joined as those of runs; a question mark stands for one that no run can have."""
    paragraphs = F.filter(F.split(text, r"\n[ \t\r]*\n"), lambda p: F.rlike(p, F.lit(r"\S")))
    each = F.transform(paragraphs, lambda p: F.when(may_be_known(p, RUN_ANCHORS), F.concat(F.lit("<"), F.sha2(canonical(p), 256), F.lit(">"))).otherwise(F.lit("?")))
    return F.when(may_be_known(text, RUN_WORDS), F.concat_ws("", each)).otherwise(F.lit(""))


def scan(docs: DataFrame, known: list[tuple[str, str]] | None = None) -> DataFrame:
    """doc_id, license_id (the licence that the whole text is, or null), n_notices, license_ids of each row of docs (doc_id, text).

    n_notices counts the text's lines and paragraphs that are a known wording (a one-line paragraph counts as a line); license_ids has the distinct licences of
    the whole text and of those, sorted, comma-joined, empty if there are none. A run of paragraphs that is a known licence (known_runs) counts as one more, unless the
    whole text is a known wording or wordings of one's own are given. Null texts count as empty. Repeated rows stay. Only parts whose canonical length some known
    wording has are hashed. The known digests are a fixed table of a few hundred rows, and are broadcast.
    """
    wordings = known or known_licenses()
    # own wordings may lack the anchors: then every text and line is made canonical
    anchors = ANCHORS if all(any(a in w.lower() for a in ANCHORS) for _, w in wordings) else ("",)
    found = stored(digests(docs.sparkSession, wordings), "license_digests")
    sizes = F.array(*[F.lit(r["size"]) for r in found.select("size").distinct().collect()])
    likely = F.when(may_be_known(F.col("text"), anchors), F.col("text")).otherwise(F.lit(""))
    parts = F.concat(F.split("text", "\n"), F.filter(F.split("text", r"\n[ \t\r]*\n"), lambda p: F.contains(p, F.lit("\n"))))
    hashed = F.transform(F.filter(F.transform(F.filter(parts, lambda p: may_be_known(p, anchors)), canonical), lambda c: F.array_contains(sizes, F.length(c))), lambda c: F.sha2(c, 256))
    sequence = F.lit("") if known else paragraph_digests(F.col("text"))
    listed = stored(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", likely.alias("text")).select("row", "doc_id", F.sha2(canonical(F.col("text")), 256).alias("whole"), hashed.alias("parts"), sequence.alias("sequence")), "license_parts")
    small = F.broadcast(found.select("digest", "license_id"))
    units = listed.where("size(parts) > 0").select("row", F.explode("parts").alias("digest")).join(small, "digest").groupBy("row").agg(F.count("*").alias("n"), F.collect_set("license_id").alias("ids"))
    in_order = listed.where("contains(sequence, '<')").join(F.broadcast(stored(runs(docs.sparkSession), "license_runs").withColumnRenamed("license_id", "id")), F.expr("contains(sequence, run)"))
    times = F.expr("(length(sequence) - length(replace(sequence, run, ''))) div length(run)")
    in_order = in_order.groupBy("row").agg(F.sum(times).alias("run_n"), F.collect_set("id").alias("run_ids"))
    whole = listed.join(small, listed["whole"] == small["digest"], "left").join(units, "row", "left").join(in_order, "row", "left")
    none = F.array().cast("array<string>")
    ids = F.array_union(F.coalesce("ids", none), F.when(F.col("license_id").isNull(), none).otherwise(F.array("license_id")))
    inside = F.col("license_id").isNull()
    ids = F.array_union(ids, F.when(inside, F.coalesce("run_ids", none)).otherwise(none))
    return whole.select("doc_id", "license_id", (F.coalesce("n", F.lit(0)) + F.when(inside, F.coalesce("run_n", F.lit(0))).otherwise(0)).cast("long").alias("n_notices"), F.array_join(F.array_sort(ids), ",").alias("license_ids"))


def op5_license_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents"))


def _sql_canonical(text: str) -> str:
    out = f"translate({text}, '{UPPER}', '{LOWER}')"
    for pattern, with_ in RULES:
        out = f"regexp_replace({out}, '{pattern}', '{with_.replace('$', chr(92))}', 'g')"
    return out


def oracle_sql() -> str:
    """The same rows by DuckDB."""
    known = ", ".join("({}, '{}', '{}')".format(i, k, w.replace("'", "''")) for i, (k, w) in enumerate(known_licenses()))
    return f"""
WITH known AS (
  SELECT sha256({_sql_canonical('wording')}) AS digest, arg_min(license_id, n) AS license_id FROM (VALUES {known}) AS t(n, license_id, wording) GROUP BY 1
), docs AS (
  SELECT row_number() OVER () AS row_no, doc_id, coalesce(text, '') AS body FROM documents
), parts AS (
  SELECT row_no, unnest(string_split(body, chr(10))) AS part FROM docs
  UNION ALL
  SELECT row_no, part FROM (SELECT row_no, unnest(string_split_regex(body, '\\n[ \\t\\r]*\\n')) AS part FROM docs) WHERE contains(part, chr(10))
), hits AS (
  SELECT row_no, license_id FROM parts JOIN known ON sha256({_sql_canonical('part')}) = digest
), units AS (
  SELECT row_no, count(*) AS n FROM hits GROUP BY 1
), wholes AS (
  SELECT row_no, license_id FROM docs JOIN known ON sha256({_sql_canonical('body')}) = digest
), ids AS (
  SELECT row_no, string_agg(license_id, ',' ORDER BY license_id) AS ids FROM (SELECT * FROM hits UNION SELECT * FROM wholes) GROUP BY 1
)
SELECT doc_id, license_id, coalesce(n, 0)::BIGINT AS n_notices, coalesce(ids, '') AS license_ids
FROM docs LEFT JOIN wholes USING (row_no) LEFT JOIN units USING (row_no) LEFT JOIN ids USING (row_no)
"""
