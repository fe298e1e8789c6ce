"""Licence scan by canonical digests.

A text is brought to a canonical form (case, copyright lines, equivalent spellings, punctuation and white space),
and the SHA-256 of the form is looked up among the digests of known licences by an equi-join. Looked up are whole
texts, their paragraphs and their lines, each entire, and every run of neighbouring lines, across paragraphs too, that
begins with the first word of a known text and has the length of one. DataFrame functions only.

The canonical form is taken once, of the whole text, line by line in place (no replacement goes beyond a line), and all
units of a text come from it in one pass. Only units whose first word and length some known text has are hashed.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerscope.functions.bounded import attach_global
from ledgerscope.llm.common import ascii_lower

#: Equivalent spellings, left to right.
SPELLINGS = [
    ("licence", "license"), ("sub-license", "sublicense"), ("sub license", "sublicense"), ("authorise", "authorize"),
    ("authorisation", "authorization"), ("favour", "favor"), ("honour", "honor"), ("modelled", "modeled"),
    ("organisation", "organization"), ("merchantibility", "merchantability"), ("non-infringement", "noninfringement"),
    ("non-commercial", "noncommercial"), ("per cent", "percent"), ("whilst", "while"), ("wilful", "willful"),
    ("copyright owner", "copyright holder"), ("https://", "http://"), ("&", " and "), ("v. ", "version "),
]
#: Lines that only say whose copyright it is, after an optional comment mark: the word with a mark, a year or "by" behind it, or
#: the mark alone. Wrapped licence lines that begin with "copyright notice" or "copyright holder" are no such lines.
COPYRIGHT_LINE = r"(^|\n)[ \t\r]*[#*/;.-]*[ \t]*((portions )?copyright:?[ \t]+(\(c\)|©|by[ \t]|[0-9]{4})|(\(c\)|©)[ \t])[^\n]*"
_GAPS = r"[\p{P}\p{S}\x00-\x20]+"
#: Marks the end of a paragraph in the canonical form of a text, in which no other control character but the line end is left.
_PARAGRAPH = "\x01"

_NO_WARRANTY = ("THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE "
                "INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY "
                "SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA "
                "OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN "
                "CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.")
_BSD_HEAD = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
             "following conditions are met:\n1. Redistributions of source code must retain the above copyright notice, this list of "
             "conditions and the following disclaimer.\n2. Redistributions in binary form must reproduce the above copyright notice, "
             "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
             "distribution.")
_BSD_TAIL = ("THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, "
             "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
             "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
             "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
             "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
             "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE "
             "OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")
#: Whole licence texts (fixed values: the public wording).
TEXTS = [
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the "
            "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
            "persons to whom the Software is furnished to do so, subject to the following conditions:\nThe above copyright notice and "
            "this permission notice shall be included in all copies or substantial portions of the Software.\nTHE SOFTWARE IS "
            "PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
            "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT "
            "HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
            "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
            "granted, provided that the above copyright notice and this permission notice appear in all copies.\n" + _NO_WARRANTY),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
             "granted.\n" + _NO_WARRANTY),
    ("BSD-2-Clause", _BSD_HEAD + "\n" + _BSD_TAIL),
    ("BSD-3-Clause", _BSD_HEAD + "\n3. Neither the name of the copyright holder nor the names of its contributors may be used to "
                     "endorse or promote products derived from this software without specific prior written permission.\n" + _BSD_TAIL),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held "
             "liable for any damages arising from the use of this software.\nPermission is granted to anyone to use this software for "
             "any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following "
             "restrictions:\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original "
             "software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but "
             "is not required.\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the "
             "original software.\n3. This notice may not be removed or altered from any source distribution."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
                   "with the License. You may obtain a copy of the License at\nhttp://www.apache.org/licenses/LICENSE-2.0\nUnless "
                   "required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
                   "\"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the "
                   "specific language governing permissions and limitations under the License."),
    ("All-Rights-Reserved", "All rights reserved."),
]
#: Names by which a one-line notice refers to a licence.
NAMES = [
    ("Apache-2.0", ["Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0 License"]),
    ("MIT", ["MIT License", "MIT license (MIT)"]), ("ISC", ["ISC License"]), ("Zlib", ["zlib License"]),
    ("BSD-2-Clause", ["BSD 2-Clause License", "Simplified BSD License"]),
    ("BSD-3-Clause", ["BSD 3-Clause License", "New BSD License", "Modified BSD License"]),
    ("GPL-2.0", ["GNU General Public License, version 2", "GNU GPL v2", "GPLv2"]),
    ("GPL-3.0", ["GNU General Public License, version 3", "GNU GPL v3", "GPLv3"]),
    ("LGPL-3.0", ["GNU Lesser General Public License, version 3", "LGPLv3"]),
    ("AGPL-3.0", ["GNU Affero General Public License, version 3", "AGPLv3"]),
    ("MPL-2.0", ["Mozilla Public License, version 2.0", "Mozilla Public License 2.0"]),
] + [(f"CC-{k.replace(' ', '-')}-4.0".upper(), [f"CC {k} 4.0", f"Creative Commons {k} 4.0", f"CC {k} 4.0 International License"])
     for k in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND")]
SUBJECTS = ["", "this work is ", "this file is ", "this software is ", "this document is ", "this content is "]
VERBS = ["licensed under ", "released under ", "distributed under ", "available under ", "distributed under the terms of "]


def known_texts() -> list[tuple[str, str]]:
    """(licence id, text): whole licences, one-line notices made of subject, verb and licence name, and SPDX tags."""
    notices = [(name_id, f"{s}{v}{the}{name}") for name_id, names in NAMES for name in names
               for s, v, the in itertools.product(SUBJECTS, VERBS, ("", "the "))]
    ids = sorted({name_id for name_id, _ in NAMES + TEXTS} - {"All-Rights-Reserved"})
    tags = [(i, f"SPDX-License-Identifier: {i}{end}") for i in ids for end in (("", "-only", "-or-later") if "GPL" in i else ("",))]
    return TEXTS + notices + tags


def _canonical_lines(text: Column) -> Column:
    """The canonical form of every line of the text in place: line ends and paragraph marks stay as they are."""
    start, rest = rf"(^|[\n{_PARAGRAPH}])", rf"[^\n{_PARAGRAPH}]*"
    out = F.regexp_replace(ascii_lower(text), COPYRIGHT_LINE.replace(r"(^|\n)", start).replace(r"[^\n]*", rest), "$1")
    for old, new in SPELLINGS:
        out = F.replace(out, F.lit(old), F.lit(new))
    out = F.regexp_replace(out, r"[\p{P}\p{S}\x00\x02-\x09\x0B-\x20]+", " ")
    return F.regexp_replace(out, rf"^ +| +$| *([\n{_PARAGRAPH}]) *", "$1")


def canonical(text: Column) -> Column:
    """Canonical form of a unit: the words of its lines joined by single blanks; null stays null."""
    return F.trim(F.regexp_replace(_canonical_lines(F.translate(text, _PARAGRAPH, " ")), "[ \n]+", " "))


def _sha(form: Column) -> Column:
    return F.sha2(form.cast("binary"), 256)


def digest(text: Column) -> Column:
    return _sha(canonical(text))


def bare_names() -> list[tuple[str, str]]:
    """(licence id, text): a licence's name alone, as in a title line."""
    return [(name_id, f"{the}{name}") for name_id, names in NAMES for name in names for the in ("", "The ")]


def known_digests(spark: SparkSession, texts: list[tuple[str, str]] | None = None) -> DataFrame:
    """(digest, license_id, head, length), one row a digest (of equal canonical texts the smallest id).

    ``head`` and ``length``: first word and number of characters of the canonical text.
    """
    rows = known_texts() + bare_names() if texts is None else texts
    form = spark.createDataFrame(rows, "license_id string, text string").select("license_id", canonical(F.col("text")).alias("form"))
    return (form.groupBy(_sha(F.col("form")).alias("digest")).agg(
        F.min("license_id").alias("license_id"), F.min(F.substring_index("form", " ", 1)).alias("head"), F.min(F.length("form")).alias("length")))


def _sizes(known: DataFrame) -> DataFrame:
    """(head, lengths): per first word of the known texts the distinct lengths of those that begin with it."""
    return known.where("length > 0").groupBy("head").agg(F.array_sort(F.collect_set("length")).alias("lengths"))


def _units(parts: Column, heads: Column, most: Column) -> Column:
    """All units of a text, from the canonical lines of its paragraphs (array of arrays).

    Structs of scope, paragraph, line, form, place, of and size. Scope 'run' marks a window: the lines from one that begins with
    a known first word on, their ends kept, as far as the longest known text reaches. ``place`` and ``of``: which of how many lines
    with words of its paragraph the first one is; ``size``: characters of the whole text.
    """
    def unit(scope: str, p: Column, n: Column, form: Column, place: Column | None = None, of: Column | None = None, size: Column | None = None) -> Column:
        zero = F.lit(0)
        return F.struct(F.lit(scope).alias("scope"), p.cast("int").alias("paragraph"), n.cast("int").alias("line"), form.alias("form"),
                        (zero if place is None else place).cast("int").alias("place"), (zero if of is None else of).cast("int").alias("of"),
                        (zero if size is None else size).cast("int").alias("size"))

    def of_lines(parts: Column) -> Column:
        worded = lambda p: F.filter(F.transform(p, lambda x, j: F.struct(j.alias("line"), x.alias("form"))), lambda x: x["form"] != "")
        flat = F.flatten(F.transform(parts, lambda p, i: F.transform(F.array(worded(p)), lambda ls: F.transform(ls, lambda x, k: F.struct(
            i.alias("paragraph"), x["line"].alias("line"), x["form"].alias("form"), k.alias("place"), F.size(ls).alias("of"))))[0]))
        return F.transform(F.array(flat), lambda lines: of_flat(parts, lines))[0]

    def of_flat(parts: Column, lines: Column) -> Column:
        text = F.array_join(F.transform(lines, lambda x: x["form"]), " ")
        return F.transform(F.array(text), lambda whole: of_all(parts, lines, whole))[0]

    def window(lines: Column, k: Column) -> Column:
        part = lambda n: F.array_join(F.transform(F.slice(lines, k + 1, n), lambda x: x["form"]), "\n")
        # a line with words takes two characters at least, so the second length holds all that the longest text can reach
        near = F.transform(F.array(part(F.lit(64))), lambda w: F.when((F.length(w) > most) | (k + 64 >= F.size(lines)), w)
                           .otherwise(part(F.floor(most / 2).cast("int") + 2)))[0]
        return near.substr(F.lit(1), most + 1)

    def of_all(parts: Column, lines: Column, whole: Column) -> Column:
        zero = F.lit(0)
        none = F.array().cast("array<struct<scope:string,paragraph:int,line:int,form:string,place:int,of:int,size:int>>")
        joined = lambda p: F.array_join(F.filter(p, lambda x: x != ""), " ")
        starts = F.filter(F.transform(lines, lambda x, k: F.when(
            (k < F.size(lines) - 1) & F.array_contains(heads, F.substring_index(x["form"], " ", 1)) & (F.length(x["form"]) < most),
            unit("run", x["paragraph"], x["line"], window(lines, k), x["place"], x["of"], F.length(whole)))), lambda u: u.isNotNull())
        return F.concat(
            F.array(unit("text", zero, zero, whole)),
            F.when(F.size(parts) > 1, F.transform(parts, lambda p, i: unit("paragraph", i, zero, joined(p)))).otherwise(none),
            F.flatten(F.transform(parts, lambda p, i: F.when(F.size(p) > 1, F.transform(p, lambda x, j: unit("line", i, j, x))).otherwise(none))),
            starts)

    return F.transform(F.array(parts), of_lines)[0]


def scan_licenses(docs: DataFrame, known: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per entire unit that is a known licence: doc_id, scope, paragraph, line, license_id, digest.

    Units: the whole text (scope 'text'; paragraph and line 0), each paragraph (parts between blank lines) of a text
    that has several, each line of a paragraph that has several, and each run of neighbouring lines that is no such
    unit (scope 'run'; paragraph and line of its first line; blank and copyright lines inside do not count); places
    count from 0, and lines end at line feeds alone. Null and empty texts have none. Null ids stay null; repeated rows
    give repeated rows; other columns are not read. ``known`` is (digest, license_id), and head and length as
    ``known_digests`` gives them, without which every unit is hashed and no runs are looked up; digests made elsewhere
    must use ``canonical``. A known table of the caller's is joined as Spark judges it, without a hint.
    """
    own = known is None
    known = known_digests(docs.sparkSession) if own else known
    hint = F.broadcast if own else (lambda df: df)  # our own table is made of the constants above
    text = F.regexp_replace(F.translate(F.col("text"), _PARAGRAPH, "\x02"), r"\n[ \t\r]*\n", _PARAGRAPH)
    texts = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).where("text <> ''")
    parts = F.transform(F.split(_canonical_lines(text), _PARAGRAPH), lambda p: F.split(p, "\n"))
    with_runs = {"head", "length"} <= set(known.columns)
    if with_runs:
        # one row: the known first words, and the longest known text
        most = known.agg(F.collect_set("head").alias("heads"), F.coalesce(F.max("length"), F.lit(0)).cast("int").alias("most"))
        texts = attach_global(texts, most)
        units = _units(parts, F.col("heads"), F.col("most"))
    else:
        units = _units(parts, F.array().cast("array<string>"), F.lit(0))
    found = texts.select("doc_id", F.explode(units).alias("u")).select("doc_id", "u.*").where("form <> ''")
    if with_runs:
        found = found.withColumn("head", F.substring_index(F.substring_index("form", "\n", 1), " ", 1)).join(hint(_sizes(known)), "head")
        fits = F.filter("lengths", lambda n: F.when(
            F.col("scope") == "run", (n <= F.length("form")) & (n < F.col("size")) & F.substr("form", n.cast("int") + 1, F.lit(1)).isin("", "\n"))
            .otherwise(n == F.length("form")))
        found = found.withColumn("length", F.explode(fits)).withColumn("form", F.substr("form", F.lit(1), F.col("length").cast("int")))
        lines = F.size(F.split("form", "\n"))
        found = found.where((F.col("scope") != "run") | ((lines > 1) & ~((F.col("place") == 0) & (lines == F.col("of")))))
    hashed = found.select("doc_id", "scope", "paragraph", "line", _sha(F.translate("form", "\n", " ")).alias("digest"))
    return hashed.join(hint(known.select("digest", "license_id")), "digest").select("doc_id", "scope", "paragraph", "line", "license_id", "digest")
