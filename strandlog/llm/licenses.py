"""Licence scans by canonical digest lookup, in DataFrame functions only.

Method: a text is brought to canonical form (lower case, copyright lines gone, equivalent spellings made one, punctuation
and white space made one blank) and its SHA-256 is looked up, in a hash join, among the digests of known licence texts. The
known texts are a fixed table of bounded size, so that side is broadcast; documents are not shuffled. Two further results
come from the same form: licences that stand somewhere in a text (from each place that begins like one, as many words as
it has are looked up by digest), and lines that are known one-line notices.

Defined results: null and empty text have the digest of the empty string and match nothing; repeated rows give repeated
rows; a known text that is itself null or empty in canonical form is ignored; of texts equal in canonical form the id that
sorts first counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Known texts beyond this many are an error: they are broadcast.
MOST_KNOWN = 100_000

# Equivalent spellings: pattern on lower-cased text, and what it becomes.
SPELLINGS = [
    ("licence", "license"),
    ("copyright holders?", "copyright owner"),
    ("merchantib", "merchantab"),
    ("non[- ]commercial", "noncommercial"),
    ("organisation", "organization"),
    ("https", "http"),
    ("&", " and "),
]

# Lines that begin with a copyright mark and a sign or year after it, to their ends, whatever marks of a comment stand before;
# and the phrase that often stands in such lines.
COPYRIGHT = "(^|\n)[^a-z0-9\n]*(copyright[^a-z0-9\n]*(\\(c\\)|©|[0-9]{4}|yyyy|year)|\\(c\\)[ \t]*[0-9]{4}|©)[^\n]*"
RESERVED = "all rights reserved"
OTHER = "[^a-z0-9¡-￿]+"


def canonical(text: Column) -> Column:
    out = F.lower(F.coalesce(text, F.lit("")))
    out = F.regexp_replace(out, F.lit(COPYRIGHT), F.lit("\n"))
    for pattern, instead in [*SPELLINGS, (RESERVED, " ")]:
        out = F.regexp_replace(out, F.lit(pattern), F.lit(instead))
    return F.trim(F.regexp_replace(out, F.lit(OTHER), F.lit(" ")))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

_ISC_TAIL = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""

_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""

_BSD_TAIL = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

#: Public licence texts, by SPDX id. Users pass their own table for more.
TEXTS = {
    "MIT": "MIT License\n\n" + _GRANT,
    "MIT-untitled": _GRANT,
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n" + _ISC_TAIL,
    "0BSD": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\n" + _ISC_TAIL,
    "BSD-2-Clause": _BSD_HEAD + _BSD_TAIL,
    "BSD-3-Clause": _BSD_HEAD + "\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n" + _BSD_TAIL,
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution.""",
    "Apache-2.0-notice": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
}

#: Words by which the beginning of a licence is told.
HEAD = 5

#: Public licence texts that are too long to stand here, as common Unix distributions carry them: SPDX id, words, first words
#: and SHA-256 of the canonical form. Fixed values.
DIGESTS = [
    ("Apache-2.0", 1602, "apache license version 2 0", "e87dea5078ce2faaea46d3475af18d30a5c0ac0f09425b60b3e0c6569f72f8d2"),
    ("Artistic-1.0-Perl", 983, "the artistic license preamble the", "bc4d0c00d493021b9f3b1041689fa28b4bf980cf2e37601f7cb475a7265e3b93"),
    ("BSD-3-Clause-UC", 214, "redistribution and use in source", "21ce5e311a0ef74591e636cf6d0a236029bcaa0ee86324ac68d5748657aa8651"),
    ("CC0-1.0", 1088, "creative commons legal code cc0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2", 3315, "gnu free documentation license version", "02a121bd244e30cfc02945b4ab6cd6889c41442a58d076deb3bd196c30c61806"),
    ("GFDL-1.3", 3732, "gnu free documentation license version", "d2f6b83bca2ec722ccbe6ee61ccf9c409b4597182b2cbdfcbb086c74086abe33"),
    ("GPL-1.0", 2067, "gnu general public license version", "596622575bcd3d827e7f6bce1f02e32bed2edeb0e9d8ce0d39441ba10031d1aa"),
    ("GPL-2.0", 2975, "gnu general public license version", "632eed5ccd9536a119e4736f4111f5ea096d69650e17f4a3fcacb4d273e39aec"),
    ("GPL-3.0", 5684, "gnu general public license version", "6d9d9a5aef0ead5d961185bbca615afe9d91b49edf03203bfb54e5a71f07a03b"),
    ("LGPL-2.0", 4200, "gnu library general public license", "87c83ddf13b8d772a493615bbfb7368fb6c87b179e064f6b4573dd9008cbd283"),
    ("LGPL-2.1", 4401, "gnu lesser general public license", "4b7fd8442d92b28972b9aee4eb75166ac0ea6267095bdcdbe488d5f54b725b71"),
    ("LGPL-3.0", 1231, "gnu lesser general public license", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", 3786, "mozilla public license version 1", "cbbde7eeab9b4d180dc00b34252f800e97fb1cddbab38ed8c0c73b956dc2cbf6"),
    ("MPL-2.0", 2426, "mozilla public license version 2", "f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a"),
]

#: One-line notices, by SPDX id.
NOTICES = {
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "MIT": "Released under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
}

#: SPDX ids whose identifier lines are notices too.
SPDX = """0BSD AFL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-2.0 Artistic-2.0 BSD-2-Clause BSD-3-Clause BSL-1.0 CC-BY-4.0 CC-BY-SA-4.0
CC0-1.0 CDDL-1.0 EPL-2.0 EUPL-1.2 GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later ISC LGPL-2.1-only LGPL-2.1-or-later
LGPL-3.0-only LGPL-3.0-or-later MIT MIT-0 MPL-2.0 MS-PL OFL-1.1 PostgreSQL Unlicense WTFPL Zlib""".split()


def lines_of(notices: dict[str, str] | None) -> list[tuple[str, str]]:
    """(id, line) of the notices to look for; by default those above and identifier lines."""
    return list((NOTICES if notices is None else notices).items()) + [(i, f"SPDX-License-Identifier: {i}") for i in SPDX if notices is None]


def known_licenses(spark: SparkSession) -> DataFrame:
    """(license_id, text, digest) of the texts, digests and notices above; either text or digest is null."""
    rows = [F.struct(F.lit(i).alias("license_id"), F.lit(text).alias("text"), F.lit(None).cast("string").alias("digest")) for i, text in [*TEXTS.items(), *NOTICES.items()]]
    rows += [F.struct(F.lit(i).alias("license_id"), F.lit(None).cast("string").alias("text"), F.lit(d).alias("digest")) for i, _, _, d in DIGESTS]
    return spark.range(1).select(F.inline(F.array(*rows)))


def scan(docs: DataFrame, known: DataFrame | None = None, notices: dict[str, str] | None = None) -> DataFrame:
    """The columns doc_id, digest, license_id (of the whole text, null if unknown), blocks array<string> (ids of the licences of
    TEXTS and DIGESTS that stand in the text, sorted), notices array<string> (ids of lines, sorted).

    known: (license_id, text) or (license_id, text, digest). notices: id to line.
    """
    spark = docs.sparkSession
    known = known if known is not None else known_licenses(spark)
    own = F.when(canonical(F.col("text")) != "", digest(F.col("text")))
    key = F.coalesce(F.col("digest"), own) if "digest" in known.columns else own
    table = known.select("license_id", key.alias("known_digest")).filter("known_digest is not null").groupBy("known_digest").agg(F.min("license_id").alias("license_id"))
    if (n := table.limit(MOST_KNOWN + 1).count()) > MOST_KNOWN:
        raise ValueError(f"over {n - 1} known texts")
    formed = docs.select("doc_id", "text", canonical(F.col("text")).alias("form"))
    found = formed.select("doc_id", F.sha2("form", 256).alias("digest"), "text", F.split("form", " ").alias("words"))
    found = found.select("doc_id", "digest", _blocks(F.col("words")).alias("blocks"), _notices(F.col("text"), lines_of(notices)).alias("notices"))
    return found.join(F.broadcast(table), found.digest == table.known_digest, "left").select("doc_id", "digest", "license_id", "blocks", "notices")


def _blocks(words: Column) -> Column:
    """Known texts are constants, so their heads and digests are worked out once for a query."""
    forms = [(i, canonical(F.lit(text))) for i, text in TEXTS.items()]
    rows = [(F.lit(i), F.size(F.split(c, " ")), F.array_join(F.slice(F.split(c, " "), 1, HEAD), " "), F.sha2(c, 256)) for i, c in forms]
    rows += [tuple(map(F.lit, r)) for r in DIGESTS]
    table = F.array(*[F.struct(i.alias("id"), n.cast("int").alias("n"), head.alias("head"), d.alias("digest")) for i, n, head, d in rows])
    firsts = F.array_distinct(F.array(*[F.substring_index(head, " ", 1) for _, _, head, _ in rows]))

    def stretch(at: Column, n) -> Column:
        return F.array_join(F.slice(words, at, n), " ")

    def at_place(at: Column) -> Column:
        same = F.filter(table, lambda t: (t["head"] == stretch(at, F.lit(HEAD))) & (t["digest"] == F.sha2(stretch(at, t["n"]), 256)))
        return F.transform(same, lambda t: t["id"])

    places = F.filter(F.sequence(F.lit(1), F.size(words)), lambda at: F.array_contains(firsts, F.element_at(words, at)))
    return F.array_sort(F.array_distinct(F.flatten(F.transform(places, at_place))))


def _notices(text: Column, lines: list[tuple[str, str]]) -> Column:
    if not lines:
        return F.array().cast("array<string>")
    keys = [canonical(F.lit(line)) for _, line in lines]
    table = F.map_from_arrays(F.array(*keys), F.array(*[F.lit(i) for i, _ in lines]))
    # Every line is brought to canonical form: neither its length nor a word in it tells beforehand that it matches none.
    found = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.try_element_at(table, canonical(x)))
    return F.array_sort(F.array_distinct(F.filter(found, lambda x: x.isNotNull())))


def _sql_canonical(text: str) -> str:
    out = f"lower(coalesce({text}, ''))"
    for pattern, instead in [(COPYRIGHT, "\n"), *SPELLINGS, (RESERVED, " "), (OTHER, " ")]:
        out = f"regexp_replace({out}, '{pattern}', '{instead}', 'g')"
    return f"trim({out})"


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'" for x in r) + ")" for r in rows)


def oracle_sql() -> str:
    return f"""
WITH whole AS (SELECT license_id, {_sql_canonical("text")} AS form FROM (VALUES {_values(list(TEXTS.items()))}) AS t(license_id, text)),
block AS (SELECT license_id, len(string_split(form, ' ')) AS n, array_to_string(string_split(form, ' ')[1:{HEAD}], ' ') AS head, sha256(form) AS digest FROM whole
  UNION ALL SELECT * FROM (VALUES {_values(DIGESTS)}) AS t(license_id, n, head, digest)),
notice AS (SELECT {_sql_canonical("text")} AS form, license_id FROM (VALUES {_values(lines_of(None))}) AS t(license_id, text)),
known AS (SELECT digest, min(license_id) AS license_id FROM (SELECT digest, license_id FROM block UNION ALL SELECT sha256({_sql_canonical("text")}), license_id FROM (VALUES {_values(list(NOTICES.items()))}) AS t(license_id, text)) GROUP BY digest),
d AS (SELECT doc_id, {_sql_canonical("text")} AS form, text FROM documents),
w AS (SELECT DISTINCT doc_id, string_split(form, ' ') AS words FROM d),
place AS (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS k FROM w),
inside AS (SELECT doc_id, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS ids FROM place JOIN block ON block.head = array_to_string(words[k:k + {HEAD - 1}], ' ') AND block.digest = sha256(array_to_string(words[k:k + n - 1], ' ')) GROUP BY doc_id),
line AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), '\n')) AS x FROM d),
found AS (SELECT doc_id, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS ids FROM (SELECT doc_id, {_sql_canonical("x")} AS form FROM line) JOIN notice USING (form) GROUP BY doc_id)
SELECT d.doc_id, sha256(d.form) AS digest, known.license_id, coalesce(inside.ids, '') AS blocks, coalesce(found.ids, '') AS notices
FROM d LEFT JOIN known ON known.digest = sha256(d.form) LEFT JOIN inside ON d.doc_id = inside.doc_id LEFT JOIN found ON d.doc_id = found.doc_id
"""
