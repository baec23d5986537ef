"""Known licence texts among documents, by the digest of the whole text in canonical form.

Native throughout: canonical form, digest and join are Spark SQL functions. The canonical form lower-cases. Where a text
has a word that licences have (KEYWORDS), it then drops lines that state a copyright, "all rights reserved", a first line that is
the licence's title, list numbers and what follows "end of terms and conditions"; it spells variant words one way
and writes one holder for the names that BSD-like texts fill in. In every text, each run of white space, ASCII
punctuation and typographic marks becomes one blank. Two texts with the same canonical form are the same licence text;
a licence inside a longer text is no match. A text, or a line of one, that only names its licence ("Released under the
MIT License.") is a notice: without its beginning, its canonical form is looked up among licence names.

A copyright line begins, after marks, with "copyright", a year after "(c)", or the sign, and has at most 200 more characters;
a text that is one line thus keeps its copyright statement and is not known. A title is known in a line of its own or in
the same line as the text. Other lines before or after the licence make another text.

Null and empty texts have the digest of the empty string, no licence and no notice. A text that several names share goes by
the first name in order. Repeated rows each get their row. Other columns are ignored, very long texts need nothing
special, an empty table gives an empty result. The licences known by themselves are the constants of this module, so their
broadcast is bounded; any table of further texts can be given instead, and Spark chooses how it is joined.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: words that licence texts spell in two ways
SPELLINGS = (
    ("sub-licen", "sublicen"), ("sub licen", "sublicen"), ("licence", "license"), ("licencing", "licensing"), ("acknowledgement", "acknowledgment"), ("authorisation", "authorization"),
    ("authorised", "authorized"), ("organisation", "organization"), ("merchantibility", "merchantability"), ("non-infringement", "noninfringement"), ("favour", "favor"),
    ("judgement", "judgment"), ("wilful", "willful"), ("whilst", "while"), ("copyright owner", "copyright holder"), ("https:", "http:"), ("per cent", "percent"), ("programme", "program"),
    ("recognised", "recognized"), ("initialise", "initialize"), ("analogue", "analog"), ("catalogue", "catalog"), ("fulfilment", "fulfillment"), ("labour", "labor"), ("offence", "offense"),
)

_PERMISSION = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the "
    "Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, "
    "and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall "
    "be included in all copies or substantial portions of the Software.\n\n"
)
_AS_IS = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A "
    "PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF "
    "CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and "
    "this permission notice appear in all copies.\n\n"
)
_ZERO = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\n"
_AUTHOR = (
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. "
    "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
    "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n"
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n"
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
    "materials provided with the distribution.\n\n"
)
_BSD_NAMES = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific "
    "prior written permission.\n\n"
)
_BSD_AS_IS = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES "
    "OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, "
    "INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR "
    "BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY "
    "WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
# fixed values: licence texts by SPDX name; lines with a copyright are left out, as the canonical form does
LICENSES = (
    ("0BSD", _ZERO + _AUTHOR),
    ("BSD-2-Clause", _BSD + _BSD_AS_IS),
    ("BSD-3-Clause", _BSD + _BSD_NAMES + _BSD_AS_IS),
    ("ISC", _ISC + _AUTHOR),
    ("MIT", "MIT License\n\n" + _PERMISSION + _AS_IS),
)
# fixed values: titles that these licences go by
TITLES = {
    "0BSD": ("Zero-Clause BSD", "Zero-Clause BSD License", "BSD Zero Clause License"), "BSD-2-Clause": ("BSD 2-Clause License", "BSD 2-Clause \"Simplified\" License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "BSD 3-Clause \"New\" or \"Revised\" License"), "ISC": ("ISC License", "The ISC License", "ISC License (ISC)"), "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)"),
}
# fixed values: canonical digests of longer licence texts as their stewards publish them, with the title dropped and kept
DIGESTS = (
    ("Apache-2.0", "c46d6bbbba9e687e96007fb7800cc6a9dc0a43ca75d5b637593898d0a1c03c9d", "a8ac09b3ebd12f4168f35efd62dce9c321a3d923c725504623898a8dc6fc49e3"),
    ("Artistic-1.0-Perl", "538e2e59281ba267abc1d1844748259521b4d2f0e90e9cca0ee2b8a86ffbe6fa", "4834e699353522cfb463bd8b374752ecf02156bb3f5dfb53d0edb502a112a651"),
    ("CC0-1.0", "38ef173883793b023a74895ce0af4bbdeb6bb0bc904463871c507b03695c9c81", "38ef173883793b023a74895ce0af4bbdeb6bb0bc904463871c507b03695c9c81"),
    ("GFDL-1.2", "e3108aa892082bca5ab29103e1ff822c6501deb4ba69b3acbc3839e12d51ffff", "acec3597763489be8ef21cf2e96b3ed208cb48bcddc6c598aff3724672e280f0"),
    ("GFDL-1.3", "48f764c23812d8372595eb725d83122d7d234eb015039a0f9a699e898efca018", "96126db0aa4a0e77dd3344ee5c1afb9c7243997a829d69325ebcb1448f7264e3"),
    ("GPL-1.0", "51999a77920fd84fda4488b7951a8e6a67a10b63c98f5433ba22dbc7328522e9", "747297ecf29429fff72f8119146b5f17b0a1c2aec561bac4913720428af3cf75"),
    ("GPL-2.0", "20156b89d1c0e4666a47430b76bf7908cff10a840e54c3b1f74128e720563e6b", "f5f444394912ae2bc65e44425f0a3a8071b2f7f2ad2df371789e0f95c5382893"),
    ("GPL-3.0", "1407ca1cd13936e60f29f3f8b9c4982dfb26946c8d7bfd29ca83c0985f9956f7", "b47544380190ec795574ed2e9986c13e19272649a4047f4eead69370b2486171"),
    ("LGPL-2.0", "9e38d196e3b47dcf9ace530e9acd02a6372fab3759e418879eb68721e6084f01", "f6dc5cd2f8d56b80dacf0b5f4412099e7029d054beea86e0ce0dcd3098e9f5c1"),
    ("LGPL-2.1", "8a35755dc06ee32fc358732f8d89a0a5569681311e5b651aed1c4a191b8d7191", "6ad660ce7213b3936d685c9ada84361135e273f79189cf0cd0a298e16764def8"),
    ("LGPL-3.0", "1e0c111521caea0af55c9ba20c71d4eb4e955b8d00d6c6ef080c8f944dd6fc90", "6a1e21cb1f0adda77c68071a8eeadb804a92ffdcaa150c17f976711652333fa0"),
    ("MPL-1.1", "847722a876cb3599dddd9849acce9fd1a321914e2c12e43f978d66410afc352e", "5aa16067e47a822b554b495ff7af4677e24d8672c24a205ea3050b9cc509139b"),
    ("MPL-2.0", "0142bb9219d69ed4226abefa2c4bd51ad8528f79c8c3d41ef366cd145412aa1f", "5b3f6d23fe8b43a89beb9abe4a2615ea12be4b87a8a8217c10abf91990dd0994"),
)
# fixed values: names of licences in notices, by SPDX name
NAMES = {
    "0BSD": ("Zero-Clause BSD License",), "AGPL-3.0": ("GNU Affero General Public License, version 3",), "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License"),
    "BSD-2-Clause": ("BSD 2-Clause License", "Simplified BSD License"), "BSD-3-Clause": ("BSD 3-Clause License", "New BSD License", "Modified BSD License"), "CC-BY-4.0": ("CC BY 4.0", "Creative Commons Attribution 4.0 International License"),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"), "CC-BY-SA-4.0": ("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"), "CC0-1.0": ("CC0 1.0", "CC0 1.0 Universal"),
    "EPL-2.0": ("Eclipse Public License, version 2.0", "Eclipse Public License 2.0"), "GPL-2.0": ("GNU General Public License, version 2", "GNU GPL v2", "GPLv2"), "GPL-3.0": ("GNU General Public License, version 3", "GNU GPL v3", "GPLv3"),
    "ISC": ("ISC License",), "LGPL-2.1": ("GNU Lesser General Public License, version 2.1",), "LGPL-3.0": ("GNU Lesser General Public License, version 3",), "MIT": ("MIT License", "MIT"),
    "MPL-2.0": ("Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "MPL 2.0"), "Unlicense": ("Unlicense",),
}
# fixed values: how a notice begins
SUBJECTS = ("work", "file", "software", "program", "project", "document", "code", "package", "library")
VERBS = ("licensed", "released", "distributed", "available", "published")
NOTICE = f"^((this|the) ({'|'.join(SUBJECTS)}) is )?({'|'.join(VERBS)}) under (the terms of )?(the )?|^spdx license identifier "
#: A line with more characters is no notice.
NOTICE_CHARS = 200

KEYWORDS = ("copyright", "licen", "warrant")
# fixed values: words after "copyright" with which it names the right and states no holder
NO_HOLDER = "notices?|holders?|owners?|laws?|licen[sc]es?|and|or|interests?|statements?|treaty|treaties|permissions?|protection|disclaimers?|on|to|in|is|of|from|for|as|status"
COPYRIGHT_LINE = rf"(?md)^[^\w\n]{{0,20}}(?:copyright\b(?![^\w\n]*(?:{NO_HOLDER})\b)|\(c\) *[0-9]{{4}}|©)[^\n]{{0,200}}$"
RIGHTS = r"all rights reserved\.?"
TITLE = r"^\s*[^\n]{0,60}licen[sc]e[^\n]{0,40}\n"
NUMBERS = r"(^|[ \t\n])[(]?([0-9]{1,2}|[a-z])[.)][ \t\n]"
MARKS = "[\\s!-/:-@\\[-`{-~©«»–—‘’“”•…]+"
#: Passages in which a holder's name may stand, in canonical words, and what is written for them.
FILLED = (
    ("(?s)neither the names? of .{1,150}? nor the names of (its|their|the) contributors", "neither the name of the holder nor the names of its contributors"),
    ("(?s)provided by .{1,150}? as is", "provided by the holder as is"),
    ("(?s)in no event shall .{1,150}? be liable", "in no event shall the holder be liable"),
    ("(?s) end of terms and conditions .*$", " end of terms and conditions"),
)


def canonical(text: Column, title: bool = False) -> Column:
    """The canonical form of a text; title: one that keeps the first line, as if the next followed in the same line."""
    lower = F.lower(F.coalesce(text, F.lit("")))
    marked = lambda words: F.trim(F.regexp_replace(words, MARKS, " "))
    words = F.replace(F.replace(lower, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    for pattern in (COPYRIGHT_LINE, RIGHTS, *(() if title else (TITLE,))):
        words = F.regexp_replace(words, pattern, "")
    words = F.regexp_replace(words, NUMBERS, " ")
    for variant, word in SPELLINGS:
        words = F.replace(words, F.lit(variant), F.lit(word))
    words = marked(words)
    for pattern, filled in FILLED:
        words = F.regexp_replace(words, pattern, filled)
    stated = F.lit(False)
    for word in KEYWORDS:
        stated = stated | F.contains(lower, F.lit(word))
    return F.when(stated, words).otherwise(marked(lower))


def digest(text: Column, title: bool = False) -> Column:
    return F.sha2(canonical(text, title), 256)


def _plain(name: str) -> str:
    return re.sub(MARKS, " ", name.lower()).strip()


def named() -> dict[str, str]:
    """SPDX names by what a notice says after its beginning, in canonical words."""
    return {_plain(x): spdx for spdx, names in NAMES.items() for x in (*names, spdx)}


def notice(text: Column) -> Column:
    """The licence to which a text refers that is nothing but a notice, else null."""
    table = F.create_map(*[F.lit(x) for pair in named().items() for x in pair])
    words = canonical(text)
    return F.when((F.length(text) <= NOTICE_CHARS) & words.rlike(NOTICE), F.try_element_at(table, F.regexp_replace(words, NOTICE, "")))


def notices(text: Column) -> Column:
    """The licences to which lines of a text refer that are notices: sorted, joined by commas."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.lower(x).rlike("under|spdx") & (F.length(x) <= NOTICE_CHARS))
    return F.coalesce(F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.transform(lines, notice)))), ","), F.lit(""))


def license_digests(texts: DataFrame) -> DataFrame:
    """canonical_sha256 and license_id of licence texts, given as name and text, each with its title dropped and kept;
    those without a word are left out."""
    both = texts.select("name", F.explode(F.array(digest(F.col("text")), digest(F.col("text"), True))).alias("canonical_sha256"))
    return both.where(F.col("canonical_sha256") != F.sha2(F.lit(""), 256)).groupBy("canonical_sha256").agg(F.min("name").alias("license_id"))


def known_licenses(spark: SparkSession) -> DataFrame:
    """canonical_sha256 and license_id of the licences known here."""
    titled = [(name, f"{title}\n\n{text}") for name, text in LICENSES for title in TITLES[name]]
    found = license_digests(spark.createDataFrame([*LICENSES, *titled], "name string, text string"))
    listed = spark.createDataFrame([(d, name) for name, *both in DIGESTS for d in both], "canonical_sha256 string, license_id string")
    return found.unionByName(listed).groupBy("canonical_sha256").agg(F.min("license_id").alias("license_id"))


def scan_licenses(documents: DataFrame, known: DataFrame | None = None, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, canonical_sha256, license_id where the whole text is a known licence, one of `known`, a table of
    name and text, or else of those known here, or a notice (then with "-notice"), and the notices among its lines."""
    docs = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    docs = docs.select("doc_id", digest(F.col("text")).alias("canonical_sha256"), F.concat(notice(F.col("text")), F.lit("-notice")).alias("noticed"), notices(F.col("text")).alias("notices"))
    table = F.broadcast(known_licenses(documents.sparkSession)) if known is None else license_digests(known)
    out = docs.join(table, "canonical_sha256", "left")
    return out.select("doc_id", "canonical_sha256", F.coalesce("license_id", "noticed").alias("license_id"), "notices")


# ---- the same in DuckDB's SQL, written apart: line by line instead of by one pattern, and without looking ahead
def _sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _sql_marked(words: str) -> str:
    return f"trim(regexp_replace({words}, {_sql_text(MARKS)}, ' ', 'g'))"


def _sql_canonical(column: str, title: bool = False) -> str:
    lower = f"lower(coalesce({column}, ''))"
    lines = f"string_split(replace(replace({lower}, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10))"
    named, holder = r"'^[^\w]{0,20}copyright\b.{0,200}$'", rf"'^[^\w]{{0,20}}copyright\b[^\w]*({NO_HOLDER})\b'"
    signed = r"'^[^\w]{0,20}(\(c\) *[0-9]{4}|©).{0,200}$'"
    keep = f"list_filter({lines}, lambda l: NOT ((regexp_matches(l, {named}) AND NOT regexp_matches(l, {holder})) OR regexp_matches(l, {signed})))"
    words = f"regexp_replace(array_to_string({keep}, chr(10)), {_sql_text(RIGHTS)}, '', 'g')"
    if not title:
        words = f"regexp_replace({words}, {_sql_text(TITLE)}, '')"
    words = f"regexp_replace({words}, {_sql_text(NUMBERS)}, ' ', 'g')"
    for variant, word in SPELLINGS:
        words = f"replace({words}, {_sql_text(variant)}, {_sql_text(word)})"
    words = _sql_marked(words)
    for pattern, filled in FILLED:
        words = f"regexp_replace({words}, {_sql_text(pattern)}, {_sql_text(filled)}, 'g')"
    stated = " OR ".join(f"contains({lower}, {_sql_text(word)})" for word in KEYWORDS)
    return f"CASE WHEN {stated} THEN {words} ELSE {_sql_marked(lower)} END"


def _sql_notice(column: str) -> str:
    table = "MAP {" + ", ".join(f"{_sql_text(k)}: {_sql_text(v)}" for k, v in named().items()) + "}"
    words = _sql_canonical(column)
    return f"CASE WHEN length({column}) <= {NOTICE_CHARS} AND regexp_matches({words}, {_sql_text(NOTICE)}) THEN element_at({table}, regexp_replace({words}, {_sql_text(NOTICE)}, ''))[1] END"


_TITLED = [*LICENSES, *((name, f"{title}\n\n{text}") for name, text in LICENSES for title in TITLES[name])]
ORACLE = f"""
WITH texts AS (SELECT * FROM (VALUES {', '.join(f'({_sql_text(n)}, {_sql_text(t)})' for n, t in _TITLED)}) AS l(name, text)),
digests AS (
  SELECT sha256({_sql_canonical('text')}) AS canonical_sha256, name FROM texts UNION ALL SELECT sha256({_sql_canonical('text', True)}), name FROM texts
  UNION ALL SELECT * FROM (VALUES {', '.join(f"('{d}', '{name}')" for name, *both in DIGESTS for d in both)}) AS l(a, b)
), known AS (SELECT canonical_sha256, min(name) AS license_id FROM digests GROUP BY 1),
docs AS (SELECT doc_id, text, sha256({_sql_canonical('text')}) AS canonical_sha256 FROM documents)
SELECT d.doc_id, d.canonical_sha256, coalesce(k.license_id, {_sql_notice('d.text')} || '-notice') AS license_id,
  coalesce(array_to_string(list_sort(list_distinct(list_filter(list_transform(
    list_filter(string_split(d.text, chr(10)), lambda x: regexp_matches(lower(x), 'under|spdx') AND length(x) <= {NOTICE_CHARS}), lambda x: {_sql_notice('x')}), lambda x: x IS NOT NULL))), ','), '') AS notices
FROM docs d LEFT JOIN known k USING (canonical_sha256)
"""
