"""Licence scans by canonical digests.

A text is brought to a canonical form (lower case, copyright lines removed, equivalent spellings
unified, punctuation and white space turned into single spaces), and the digest of the entire
text is looked up among the digests of known licences by a hash join. A licence therefore
matches whole, however it is wrapped, punctuated or credited. Lines of a text are looked up the
same way, each as an entire text, for the notices that documents carry.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import table
from .registry import query

# The list of known licences is sent to all tasks; it does not grow with the documents.
KNOWN_ROWS = 10_000

# Fixed values: (pattern, replacement), in order, on lower-case text.
SPELLINGS = [
    ("licence", "license"), ("licencing", "licensing"), ("favour", "favor"), ("organisation", "organization"),
    ("acknowledgement", "acknowledgment"), ("authorised", "authorized"), ("recognised", "recognized"),
    ("merchantibility", "merchantability"), ("non-infringement", "noninfringement"), ("per cent", "percent"),
    ("http://", "https://"), ("&", " and "),
]
COPYRIGHT_LINE = r"(?m)^[ \t]*(copyright|\(c\)|©|all rights reserved).*$"
PUNCTUATION = r"[^\p{L}\p{N}]+"

_AS_IS = """IN NO EVENT SHALL THE {holders} BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL,
EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF
LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN
ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted
provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the
following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the
following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR
IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A
PARTICULAR PURPOSE ARE DISCLAIMED. """ + _AS_IS.format(holders="COPYRIGHT HOLDER OR CONTRIBUTORS")
_ISC_TAIL = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE
INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY
SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR
PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION
WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""

# Licence texts and the notices that name a licence.
LICENCES = [
    ("MIT", """MIT License
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation
the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and
to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of
the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO
THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF
CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS
IN THE SOFTWARE."""),
    ("ISC", """ISC License
Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies.
""" + _ISC_TAIL),
    ("0BSD", """Zero-Clause BSD
Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted.
""" + _ISC_TAIL),
    ("BSD-2-Clause", f"BSD 2-Clause License\n{_BSD_HEAD}\n{_BSD_TAIL}"),
    ("BSD-3-Clause", f"""BSD 3-Clause License
{_BSD_HEAD}
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
products derived from this software without specific prior written permission.
{_BSD_TAIL}"""),
    ("Zlib", """zlib License
This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to
alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original
software. If you use this software in a product, an acknowledgment in the product documentation would be
appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original
software.
3. This notice may not be removed or altered from any source distribution."""),
    ("WTFPL", """DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE
TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION
0. You just DO WHAT THE FUCK YOU WANT TO."""),
    ("Apache-2.0 notice", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this
file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed
on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for
the specific language governing permissions and limitations under the License."""),
    ("Apache-2.0 notice", "Licensed under the Apache License, Version 2.0."),
    ("MIT notice", "Released under the MIT License."),
    ("MIT notice", "Licensed under the MIT License."),
    ("GPL-3.0 notice", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0 notice", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-NC-4.0 notice", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0 notice", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0 notice", "Licensed under CC BY-SA 4.0."),
]


def canonical(text: Column) -> Column:
    out = F.regexp_replace(F.lower(text), COPYRIGHT_LINE, " ")
    for said, meant in SPELLINGS:
        out = F.replace(out, F.lit(said), F.lit(meant))
    return F.trim(F.regexp_replace(out, PUNCTUATION, " "))


def digest(text: Column) -> Column:
    """Digest of the canonical form; NULL for a text of which nothing is left."""
    form = canonical(text)
    return F.when(form != "", F.sha2(form, 256))


def known_digests(licences: DataFrame) -> DataFrame:
    """``(licence, digest)`` of ``licences (licence, text)``; of equal texts the first name."""
    return licences.select("licence", digest(F.col("text")).alias("digest")).where(
        "digest IS NOT NULL").groupBy("digest").agg(F.min("licence").alias("licence"))


def scanned(docs: DataFrame, licences: DataFrame) -> DataFrame:
    """``(doc_id, digest, licence, notices)`` of every row of ``docs (doc_id, text)``.

    ``licence``: the one that the entire text is, else NULL. ``notices``: those that whole
    lines are, sorted and joined by commas, '' if none. NULL and empty texts have no digest.
    Repeated rows each give a row; other columns are not read.
    """
    listed = known_digests(licences).limit(KNOWN_ROWS + 1).collect()
    if len(listed) > KNOWN_ROWS:
        raise ValueError(f"the list of licences has a bound of {KNOWN_ROWS} texts")
    known = docs.sparkSession.createDataFrame(listed, "digest string, licence string")
    rows = docs.select("doc_id", "text", digest(F.col("text")).alias("digest"))
    found = rows.join(F.broadcast(known), "digest", "left")
    notices = F.lit("")
    if listed:
        by_digest = F.create_map(*[F.lit(x) for r in listed for x in (r["digest"], r["licence"])])
        lines = F.split(F.coalesce("text", F.lit("")), "\n")
        each = F.transform(lines, lambda x: F.try_element_at(by_digest, F.coalesce(digest(x), F.lit(""))))
        notices = F.array_join(F.array_sort(F.array_distinct(F.array_compact(each))), ",")
    return found.select("doc_id", "digest", "licence", notices.alias("notices"))


def default_licences(spark) -> DataFrame:
    return spark.createDataFrame(LICENCES, "licence string, text string")


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _sql_digest(text: str) -> str:
    out = f"regexp_replace(lower({text}), {_quoted(COPYRIGHT_LINE)}, ' ', 'g')"
    for said, meant in SPELLINGS:
        out = f"replace({out}, {_quoted(said)}, {_quoted(meant)})"
    return f"nullif(trim(regexp_replace({out}, {_quoted(PUNCTUATION)}, ' ', 'g')), '')"


SQL = f"""
    WITH texts(licence, text) AS (VALUES {", ".join(f"({_quoted(n)}, {_quoted(t)})" for n, t in LICENCES)}),
    known AS (SELECT sha256({_sql_digest("text")}) AS digest, min(licence) AS licence FROM texts GROUP BY 1),
    docs AS (SELECT row_number() OVER () AS row, doc_id, text FROM documents),
    lines AS (SELECT row, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM docs),
    noted AS (
        SELECT row, string_agg(DISTINCT licence, ',' ORDER BY licence) AS notices
        FROM lines JOIN known ON digest = sha256({_sql_digest("line")}) GROUP BY row)
    SELECT doc_id, sha256({_sql_digest("text")}) AS digest, licence, coalesce(notices, '') AS notices
    FROM docs LEFT JOIN known ON known.digest = sha256({_sql_digest("docs.text")}) LEFT JOIN noted USING (row)"""


@query("op1_license_scan", SQL)
def op1_license_scan(spark, sf_dir):
    return scanned(table(spark, sf_dir, "documents"), default_licences(spark))
