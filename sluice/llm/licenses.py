"""License scans by canonical digest lookup, in DataFrame functions alone.

A text is normalised (case, punctuation, copyright lines, equivalent
spellings) and the digest of the whole canonical text is hash-joined to the
digests of known licences.  Beside that, every single line of a text is
compared with known one-line notices, because documents carry notices within
other text.

Edge cases: a null or empty text, and one that is empty once normalised, has a
null digest and no licence; null ids are kept; repeated rows give repeated
results; columns other than the id and the text are ignored.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Spellings that licence matching treats as equal (left becomes right).
EQUIVALENT = (
    ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"),
    ("analyse", "analyze"),
    ("artefact", "artifact"),
    ("authoris", "authoriz"),
    ("behaviour", "behavior"),
    ("cancelled", "canceled"),
    ("catalogue", "catalog"),
    ("centre", "center"),
    ("favour", "favor"),
    ("fulfilment", "fulfillment"),
    ("initialis", "initializ"),
    ("judgement", "judgment"),
    ("labelling", "labeling"),
    ("licence", "license"),
    ("modelling", "modeling"),
    ("non-commercial", "noncommercial"),
    ("organis", "organiz"),
    ("per cent", "percent"),
    ("recognis", "recogniz"),
    ("sub-license", "sublicense"),
    ("utilis", "utiliz"),
    ("whilst", "while"),
    ("wilful", "willful"),
    ("https://", "http://"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
COPYRIGHT_LINE = r"(?m)^[ \t#/*;%.-]*(copyright|\(c\)|\x{a9}|all rights reserved)[^\n]*$"
PUNCTUATION = r"[\x00-\x09\x0b-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f\x{a0}\x{2010}-\x{2015}\x{2018}-\x{201f}\x{2026}]+"
LINE_EDGE = r" ?\n[ \n]*"

# The texts of short public licences, as published.
_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_ISC_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n"
_BSD_NAMES = "\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
_BSD_AS_IS = "\nTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
TEXTS = (
    ("MIT", "MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n" + _AS_IS),
    ("MIT-0", "MIT No Attribution\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.\n\n" + _AS_IS),
    ("ISC", "ISC License\n\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n" + _ISC_AS_IS),
    ("0BSD", "BSD Zero Clause License\n\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\n" + _ISC_AS_IS),
    ("BSD-2-Clause", "BSD 2-Clause License\n\n" + _BSD_HEAD + _BSD_AS_IS),
    ("BSD-3-Clause", "BSD 3-Clause License\n\n" + _BSD_HEAD + _BSD_NAMES + _BSD_AS_IS),
    ("Zlib", "zlib License\n\nThis software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n3. This notice may not be removed or altered from any source distribution."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.\n\nThis program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.\n\nYou should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."),
    ("WTFPL", "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE\nTERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION\n\n0. You just DO WHAT THE FUCK YOU WANT TO."),
)
# The names by which one-line notices call a licence.
NAMES = (
    ("MIT", "the MIT License"),
    ("Apache-2.0", "the Apache License, Version 2.0"),
    ("Apache-2.0", "the Apache License 2.0"),
    ("BSD-2-Clause", "the BSD 2-Clause License"),
    ("BSD-3-Clause", "the BSD 3-Clause License"),
    ("GPL-2.0-only", "the GNU General Public License, version 2"),
    ("GPL-3.0-only", "the GNU General Public License, version 3"),
    ("LGPL-3.0-only", "the GNU Lesser General Public License, version 3"),
    ("AGPL-3.0-only", "the GNU Affero General Public License, version 3"),
    ("MPL-2.0", "the Mozilla Public License, version 2.0"),
    ("CC0-1.0", "CC0 1.0"),
    ("CC-BY-4.0", "CC BY 4.0"),
    ("CC-BY-SA-4.0", "CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "CC BY-NC 4.0"),
    ("CC-BY-ND-4.0", "CC BY-ND 4.0"),
    ("CC-BY-NC-SA-4.0", "CC BY-NC-SA 4.0"),
    ("CC-BY-NC-ND-4.0", "CC BY-NC-ND 4.0"),
    ("CC-BY-SA-3.0", "CC BY-SA 3.0"),
)
PHRASES = ("licensed under {}", "released under {}", "distributed under {}", "this work is licensed under {}", "this software is licensed under {}", "this project is licensed under {}")
SPDX_LINE = "SPDX-License-Identifier: {}"


def notices() -> list[tuple[str, str]]:
    """One-line notices: every phrase with every name, and the identifier lines."""
    out = [(key, phrase.format(name)) for key, name in NAMES for phrase in PHRASES]
    return out + [(key, SPDX_LINE.format(key)) for key in dict.fromkeys([k for k, _ in NAMES] + [k for k, _ in TEXTS])]


def canonical_lines(text: Column) -> Column:
    """The canonical text, a line to each line of the source that has content."""
    out = F.translate(text, UPPER, LOWER)
    out = F.regexp_replace(out, COPYRIGHT_LINE, "")
    for old, new in EQUIVALENT:
        out = F.replace(out, F.lit(old), F.lit(new))
    out = F.regexp_replace(out, PUNCTUATION, " ")
    return F.trim(F.regexp_replace(F.concat(F.lit("\n"), out, F.lit("\n")), LINE_EDGE, "\n"))


def digest(lines: Column) -> Column:
    """The digest of a whole canonical text; null if nothing is left of it."""
    flat = F.trim(F.translate(lines, "\n", " "))
    return F.when(F.length(flat) > 0, F.sha2(flat, 256))


def known(spark: SparkSession, entries) -> DataFrame:
    """(license_id, lines) of fixed texts, built within the JVM."""
    rows = F.from_json(F.lit(json.dumps([{"license_id": k, "text": t} for k, t in entries])), "array<struct<license_id: string, text: string>>")
    return spark.range(1).select(F.inline(rows)).select("license_id", canonical_lines(F.col("text")).alias("lines"))


def catalogue(spark: SparkSession) -> DataFrame:
    """(license_id, digest) of the known whole texts and of the notices, one row a digest."""
    return known(spark, [*TEXTS, *notices()]).groupBy(digest(F.col("lines")).alias("digest")).agg(F.min("license_id").alias("license_id"))


def from_files(spark: SparkSession, path: str) -> DataFrame:
    """(license_id, digest) of whole licence texts, one a file named as its licence: further known licences for scan."""
    files = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.txt)?$", 1).alias("license_id"), canonical_lines(F.col("value")).alias("lines"))
    return files.select("license_id", digest(F.col("lines")).alias("digest")).filter(F.col("digest").isNotNull())


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", texts: DataFrame | None = None) -> DataFrame:
    """A row per row of docs: the id, text_digest, license_id (of the whole text) and notice_ids (licences of single lines, sorted, comma-separated).

    texts: (license_id, digest) of further known licences; it is hash-joined, and Catalyst broadcasts it only below the session's size limit.
    """
    spark = docs.sparkSession
    catalog = catalogue(spark)
    if texts is not None:
        catalog = catalog.unionByName(texts.select("license_id", "digest")).groupBy("digest").agg(F.min("license_id").alias("license_id"))
    spelled = sorted({(r["line"], r["license_id"]) for r in known(spark, notices()).select("license_id", F.trim(F.translate("lines", "\n", " ")).alias("line")).collect()})  # a fixed list
    lookup = F.array(*[F.struct(F.lit(line).alias("line"), F.lit(key).alias("key")) for line, key in spelled])
    lines = F.array(*[F.lit(line) for line, _ in spelled])
    base = docs.select(F.col(id_col).alias(id_col), canonical_lines(F.col(text_col)).alias("_lines"))
    found = F.array_intersect(F.split("_lines", "\n"), lines)
    out = base.select(id_col, digest(F.col("_lines")).alias("text_digest"), found.alias("_found"))
    ids = F.array_join(F.array_sort(F.array_distinct(F.transform(F.filter(lookup, lambda x: F.array_contains(F.col("_found"), x["line"])), lambda x: x["key"]))), ",")
    out = out.select(id_col, "text_digest", F.when(F.size("_found") > 0, ids).otherwise("").alias("notice_ids"))
    return out.join(catalog.withColumnRenamed("digest", "text_digest"), "text_digest", "left").select(id_col, "text_digest", "license_id", "notice_ids")


def oracle() -> str:
    """The same scan in DuckDB SQL, over documents."""
    q = lambda s: "'" + s.replace("'", "''") + "'"

    def lines(column: str) -> str:
        out = f"translate({column}, '{UPPER}', '{LOWER}')"
        out = f"regexp_replace({out}, {q(COPYRIGHT_LINE)}, '', 'g')"
        for old, new in EQUIVALENT:
            out = f"replace({out}, {q(old)}, {q(new)})"
        out = f"regexp_replace({out}, {q(PUNCTUATION)}, ' ', 'g')"
        return f"trim(regexp_replace(chr(10) || {out} || chr(10), {q(LINE_EDGE)}, chr(10), 'g'), ' ')"

    flat = "trim(translate(lines, chr(10), ' '), ' ')"
    entries = lambda rows: ", ".join(f"({q(k)}, {q(t)})" for k, t in rows)
    return f"""
    WITH whole AS (SELECT license_id, {lines('t')} AS lines FROM (VALUES {entries([*TEXTS, *notices()])}) AS v(license_id, t)),
    catalog AS (SELECT sha256({flat}) AS digest, min(license_id) AS license_id FROM whole GROUP BY 1),
    notice AS (SELECT DISTINCT license_id, {flat} AS line FROM (SELECT license_id, {lines('t')} AS lines FROM (VALUES {entries(notices())}) AS v(license_id, t))),
    base AS (SELECT row_number() OVER () AS r, doc_id, {lines('text')} AS lines FROM documents),
    hits AS (SELECT r, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS ids FROM (SELECT r, unnest(string_split(lines, chr(10))) AS line FROM base) JOIN notice USING (line) GROUP BY r),
    keyed AS (SELECT r, doc_id, CASE WHEN length({flat}) > 0 THEN sha256({flat}) END AS text_digest FROM base)
    SELECT doc_id, text_digest, license_id, coalesce(ids, '') AS notice_ids
    FROM keyed LEFT JOIN catalog ON text_digest = digest LEFT JOIN hits USING (r)
    """
