"""Licence scan by canonical digests: whole texts are normalised, hashed, and hash-joined to the digests of known licences.

DataFrame functions only. Normalising works line by line and drops what may differ between two copies of a licence: letter case,
lines that state a copyright ("copyright" with a mark, a year or "by"; a line of the licence that only begins with the word stays), lines
that are the licence's title, list marks, comment marks and other punctuation, line ends and white space; equivalent spellings
become one. Besides whole texts, the lines of a text are looked up one by one, which finds one-line notices inside other texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Equivalent spellings of licence texts, as words in lower case.
SPELLINGS = {
    "licence": "license",
    "licences": "licenses",
    "licenced": "licensed",
    "licencing": "licensing",
    "sublicence": "sublicense",
    "sub license": "sublicense",
    "sub licence": "sublicense",
    "acknowledgement": "acknowledgment",
    "organisation": "organization",
    "favour": "favor",
    "behaviour": "behavior",
    "judgement": "judgment",
    "non commercial": "noncommercial",
    "non infringement": "noninfringement",
    "https": "http",
    "copyright owner": "copyright holder",
    "copyright owners": "copyright holders",
}

# Texts of well-known licences, and notices by which works name theirs.
KNOWN = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "MIT-0": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution.""",
    "BSL-1.0": """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "Unlicense": """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org>""",
    "PostgreSQL": """Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies.

IN NO EVENT SHALL THE UNIVERSITY OF CALIFORNIA BE LIABLE TO ANY PARTY FOR DIRECT, INDIRECT, SPECIAL, INCIDENTAL, OR CONSEQUENTIAL DAMAGES, INCLUDING LOST PROFITS, ARISING OUT OF THE USE OF THIS SOFTWARE AND ITS DOCUMENTATION, EVEN IF THE UNIVERSITY OF CALIFORNIA HAS BEEN ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.

THE UNIVERSITY OF CALIFORNIA SPECIFICALLY DISCLAIMS ANY WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE. THE SOFTWARE PROVIDED HEREUNDER IS ON AN "AS IS" BASIS, AND THE UNIVERSITY OF CALIFORNIA HAS NO OBLIGATIONS TO PROVIDE MAINTENANCE, SUPPORT, UPDATES, ENHANCEMENTS, OR MODIFICATIONS.""",
    "Apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "GPL-3.0-or-later-header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.

You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.""",
    "MPL-2.0-header": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
}

LINE = r"\r\n?|\n"
# What a line in lower case may be, whatever marks stand before it.
COPYRIGHT = r"^[^\p{L}\p{N}]*(?:copyright|copr\.?)[ \t]*(?:\(c\)|©|&copy;|by |[<\[{(]*(?:[0-9]{4}|year|yyyy))[^\n]*$|^[^\p{L}\p{N}]*(?:\(c\)|©|&copy;)[ \t]*(?:copyright|[<\[{(]*(?:[0-9]{4}|year|yyyy))[^\n]*$"
RESERVED = r"^[^\p{L}\p{N}]*all rights reserved[^\p{L}\p{N}]*$"
TITLE = r"^[^\p{L}\p{N}]*(?:the )?(?:mit|mit-0|mit no attribution|isc|zlib|postgresql|boost software|unlicense|bsd|new bsd|simplified bsd|modified bsd|bsd zero[ -]clause|zero[ -]clause bsd|(?:bsd )?[0123]-clause(?: bsd)?)(?: .?(?:simplified|new|revised).?)?(?: licen[sc]e)(?: ?\((?:mit|mit-0|isc)\))?(?: - version 1\.0(?: - august 17th, 2003)?)?[^\p{L}\p{N}]*$"
MARK = r"^[^\p{L}\p{N}]*(?:[0-9]{1,2}|[a-z])[.)][ \t]"


def lines(text: Column) -> Column:
    """The lines of a text as words in lower case with one blank between them; empty for a line that says nothing."""

    def form(line: Column) -> Column:
        for dropped in (COPYRIGHT, RESERVED, TITLE, MARK):
            line = F.regexp_replace(line, dropped, "")
        return F.trim(F.regexp_replace(line, r"[^\p{L}\p{N}]+", " "))

    return F.transform(F.split(F.lower(F.coalesce(text, F.lit(""))), LINE), form)


def spelt(words: Column) -> Column:
    """Words with equivalent spellings made one. Every word has blanks of its own meanwhile, so neighbours can't hide each other."""
    out = F.concat(F.lit(" "), F.replace(words, F.lit(" "), F.lit("  ")), F.lit(" "))
    for old, new in SPELLINGS.items():
        out = F.replace(out, F.lit(f" {old.replace(' ', '  ')} "), F.lit(f" {new.replace(' ', '  ')} "))
    return F.replace(F.trim(out), F.lit("  "), F.lit(" "))


def _joined(forms: Column) -> Column:
    return spelt(F.array_join(F.filter(forms, lambda x: x != ""), " "))


def canonical(text: Column) -> Column:
    """The canonical form of a whole text; null and texts without letters or digits give the empty form."""
    return _joined(lines(text))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def read_known(spark: SparkSession, folder: str) -> DataFrame:
    """(license_id, text) of a folder of licence texts, such as a distribution's; the id is the file's name without extension."""
    files = spark.read.text(folder, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    return files.select(F.regexp_extract("path", r"([^/]+?)(\.[A-Za-z]+)?$", 1).alias("license_id"), "text")


def known_texts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(KNOWN.items()), "license_id string, text string")


def known_digests(texts: DataFrame) -> DataFrame:
    """(license_id, digest) of (license_id, text), one row a digest: of equal ones the first id. Its size is the list's, not the data's."""
    return texts.where(canonical(F.col("text")) != "").groupBy(digest(F.col("text")).alias("digest")).agg(F.min("license_id").alias("license_id"))


def scan(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, *keep, digest, license_id or null, line_licenses) of every row. Texts without letters or digits match nothing.

    line_licenses are the ids, in order, of known texts that stand as a line of their own. A list of known texts over Spark's
    broadcast limit is joined by shuffling digests; texts never move.
    """
    ids = {r["digest"]: r["license_id"] for r in known.collect()}  # as long as the list of known texts
    formed = docs.select(id_col, *keep, lines(F.col(text_col)).alias("__lines"))
    found = F.array(*map(F.lit, sorted(set(ids.values())))).cast("array<string>") if not ids else None
    if ids:
        table = F.create_map(*[F.lit(x) for pair in ids.items() for x in pair])
        each = F.transform(F.filter("__lines", lambda x: x != ""), lambda x: F.try_element_at(table, F.sha2(spelt(x), 256)))
        found = F.array_sort(F.array_distinct(F.filter(each, lambda x: x.isNotNull())))
    hashed = formed.select(id_col, *keep, F.sha2(_joined(F.col("__lines")), 256).alias("digest"), found.alias("line_licenses"))
    return hashed.join(known, "digest", "left").select(id_col, *keep, "digest", "license_id", "line_licenses")


def licence_files(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text): for each document a licence file as works carry them, by its id: one of the known texts under a copyright line, in
    capitals or not, in British spelling or not, wrapped, commented out or not, and now and then with the document's text behind it."""
    n = known.count()
    # As long as the list of known texts, in order of their ids.
    numbered = known.agg(F.array_sort(F.collect_list(F.struct("license_id", "text"))).alias("all")).select(F.posexplode("all").alias("k", "one")).select("k", F.col("one.text").alias("known"))
    k = F.pmod(F.col(id_col), F.lit(n))
    turn = F.floor(F.col(id_col) / n)
    rows = docs.where(F.col(id_col).isNotNull()).withColumn("k", k.cast("int")).join(F.broadcast(numbered), "k")
    text = F.regexp_replace("known", r"(\S+ \S+ \S+ \S+ \S+ \S+ \S+ \S+) ", "$1\n")
    text = F.when(F.pmod(turn, F.lit(3)) == 1, F.regexp_replace(F.regexp_replace(text, "sublicense", "sub-licence"), "License", "Licence")).otherwise(text)
    text = F.when(F.pmod(turn, F.lit(2)) == 1, F.upper(text)).otherwise(text)
    text = F.concat(F.lit("Copyright (c) "), (F.lit(1990) + F.pmod(turn, F.lit(30))).cast("string"), F.lit(" The Authors of No. "), F.col(id_col).cast("string"), F.lit("\nAll rights reserved.\n\n"), text)
    text = F.when(F.pmod(turn, F.lit(5)) == 2, F.concat(F.lit("# "), F.replace(text, F.lit("\n"), F.lit("\n# ")))).otherwise(text)
    text = F.when(F.pmod(turn, F.lit(7)) == 3, F.concat(text, F.lit("\n"), F.coalesce(F.col(text_col), F.lit("")))).otherwise(text)
    return rows.select(id_col, text.alias(text_col))


def op8_licence_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, and a licence file derived from each, against the known texts."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    known = known_texts(spark)
    both = docs.withColumn("part", F.lit("document")).unionByName(licence_files(docs, known).withColumn("part", F.lit("licence")))
    out = scan(both, known_digests(known), keep=("part",))
    return out.select("doc_id", "part", "digest", "license_id", F.array_join("line_licenses", ",").alias("line_licenses"))


def _oracle() -> str:
    def line_form(x: str) -> str:
        for dropped in (COPYRIGHT, RESERVED, TITLE, MARK):
            x = f"regexp_replace({x}, '{dropped}', '')"
        return rf"trim(regexp_replace({x}, '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"

    def spelling(x: str) -> str:
        words = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in SPELLINGS.items() if " " not in a)
        out = f"array_to_string(list_transform(string_split({x}, ' '), lambda w: CASE w {words} ELSE w END), ' ')"
        for a, b in SPELLINGS.items():
            if " " in a:
                out = rf"regexp_replace({out}, '\b{a}\b', '{b}', 'g')"
        return out

    lines_of = lambda c: f"list_filter(list_transform(string_split_regex(lower(coalesce({c}, '')), '{LINE}'), lambda x: {line_form('x')}), lambda y: y <> '')"
    rows = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in KNOWN.items())
    n = len(KNOWN)
    return rf"""
WITH known(license_id, text) AS (VALUES {rows}),
numbered AS (SELECT row_number() OVER (ORDER BY license_id) - 1 AS k, text AS known FROM known),
digests AS (SELECT sha256({spelling(f"array_to_string({lines_of('text')}, ' ')")}) AS digest, min(license_id) AS license_id FROM known GROUP BY 1),
v1 AS (SELECT doc_id, d.text, doc_id // {n} AS turn, regexp_replace(known, '(\S+ \S+ \S+ \S+ \S+ \S+ \S+ \S+) ', '\1' || chr(10), 'g') AS t FROM documents d JOIN numbered ON k = doc_id % {n}),
v2 AS (SELECT doc_id, text, turn, CASE WHEN turn % 3 = 1 THEN replace(replace(t, 'sublicense', 'sub-licence'), 'License', 'Licence') ELSE t END AS t FROM v1),
v3 AS (SELECT doc_id, text, turn, 'Copyright (c) ' || (1990 + turn % 30) || ' The Authors of No. ' || doc_id || chr(10) || 'All rights reserved.' || chr(10) || chr(10) ||
       CASE WHEN turn % 2 = 1 THEN upper(t) ELSE t END AS t FROM v2),
v4 AS (SELECT doc_id, text, turn, CASE WHEN turn % 5 = 2 THEN '# ' || replace(t, chr(10), chr(10) || '# ') ELSE t END AS t FROM v3),
rows_ AS (SELECT doc_id, 'document' AS part, text FROM documents UNION ALL
          SELECT doc_id, 'licence', CASE WHEN turn % 7 = 3 THEN t || chr(10) || coalesce(text, '') ELSE t END FROM v4),
formed AS (SELECT doc_id, part, {lines_of('text')} AS l FROM rows_),
hashed AS (SELECT doc_id, part, sha256({spelling("array_to_string(l, ' ')")}) AS digest, list_transform(l, lambda x: sha256({spelling('x')})) AS each FROM formed)
SELECT doc_id, part, h.digest, d.license_id,
       array_to_string(list_sort(list_distinct(list_filter(list_transform(each, lambda e: ids[e]), lambda i: i IS NOT NULL))), ',') AS line_licenses
FROM hashed h CROSS JOIN (SELECT map_from_entries(list((digest, license_id))) AS ids FROM digests) LEFT JOIN digests d ON h.digest = d.digest
"""


ORACLE = _oracle()
