"""Licence scan by canonical digests.

Text is put in a canonical form (lower case, copyright lines dropped, punctuation and runs of white space
as one space, equivalent spellings made one), hashed, and joined with the digests of known licences and
notices brought to the same form. Looked up are the entire text of a document, each of its lines, and each
run of as many words as a known text has that begins a line with that text's first words: a licence that a
document contains, however its lines are wrapped. Matching is by equality of whole canonical texts only, so
prose that merely mentions a licence is not matched.

The known texts are few and of fixed number (``TEXTS``, ``NOTICES``, ``DIGESTS``), or a caller's table of at
most ``most`` rows, so they go to every task; the documents are never shuffled.

Cases. Null and empty text, or nothing left after normalisation: no match. A document may hold several
notices and the same one several times; ``notices`` counts lines. Known licences with equal digests: the
least license_id is reported. Repeated rows are each reported.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Canonical form, in order: (pattern, replacement). Plain enough for any regex engine; applied to lower-cased text.
# A copyright line says who or when; a line that goes on with "copyright notice" or "(c) You must" is text.
COPYRIGHT_LINE = (r"(^|\n)[ \t]*((#|//|\*|;|--)+[ \t]*)?(copyright[ \t:,]*(\(c\)|©|<|\[|[0-9]|by |the )|\(c\)[ \t]*(copyright|<|\[|[0-9])|©|all rights reserved)[^\n]*", "\n")
STEPS = [
    COPYRIGHT_LINE,
    (r"[^\p{L}\p{N}\n]+", " "),
    (r"\b((sub|re) ?)?licen[cs](e|es|ed|ing|ees?|ors?)\b", "${2}licens${3}"),
    (r"\b(fav|lab|hon|col|behavi)our", "${1}or"),
    (r"([a-z]{3})is(e|ed|es|ing|ation|ations)\b", "${1}iz${2}"),
    (r"\b(acknowledg|judg)ement", "${1}ment"),
    (r"\b(non) commercial", "${1}commercial"),
    (r" *\n[ \n]*", "\n"),
]

# Short public licence notices and texts, by SPDX identifier.
NOTICES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]

# Whole texts of short public licences, by SPDX identifier, without their copyright lines.
TEXTS = [
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("MIT-0", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("BSD-2-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("BSD-3-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("0BSD", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("Zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""),
    ("BSL-1.0", """Boost Software License - Version 1.0 - August 17th, 2003
Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:
The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("Unlicense", """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
]

# Long licences by the digest of their canonical whole text: identifier, digest, words, characters, first words.
DIGESTS = [
    ("Apache-2.0", "995e05c6f6c138e8fd3dd3fdf126ff1b9d60f1566ef94ba682365966857707b4", 1602, 9882, "apache license version 2"),
    ("GPL-2.0", "f8faccf9eef7b0b5c62695c676bc1b7556d8a6fe97832b3f28aad83367b8cf30", 2975, 17117, "gnu general public license"),
    ("GPL-3.0", "385699ef9e35d716c7b936854959e0ea7930ca53f2a96b1570dfbe3fe1c7ff92", 5684, 33409, "gnu general public license"),
    ("LGPL-2.0", "3ddfc520f2bb1838f166a81a40eeda69ffacdfe08bed56305164b830182a4565", 4200, 24130, "gnu library general public"),
    ("LGPL-2.1", "c4f3b44fac45fbef91fc0fb4d2cfdb6917f361158cf8657bd854e6d847bd0fd6", 4401, 25217, "gnu lesser general public"),
    ("LGPL-3.0", "9111884d93a72b30a3d024876dab3d755949ac2cfab230268a4169a93b86560c", 1231, 7104, "gnu lesser general public"),
    ("MPL-1.1", "3a8289d584060e24f08a1915804d25369db10d4cc1179ba6ad0711b9b0b66250", 3789, 22468, "mozilla public license version"),
    ("MPL-2.0", "503ec9df345a64ee28ec8292e7341c71a0a43906106afdd1abbadaf35baf4375", 2426, 14341, "mozilla public license version"),
    ("CC0-1.0", "97098b9d4d582064b16255ff38f4b45a41ecce484eb98a46cdb15423d6de9f85", 1088, 6692, "creative commons legal code"),
    ("GFDL-1.3", "6114e20795948f0a37c6787b82086a421c231ab9030dd8f85af59433046cc9e6", 3732, 22015, "gnu free documentation license"),
    ("Artistic-1.0-Perl", "065afd054b7b3891100d80895d113a7c684cbc25122fa1c526244c852fe5a9ba", 983, 5833, "the artistic license preamble"),
]
HEAD = 4  # words by which a run that may be a known text is found
LEAST = 40  # words of a text that is looked for within documents


def canonical(text: Column) -> Column:
    """Canonical text whose lines are still apart."""
    out = F.lower(text)
    for pattern, to in STEPS:
        out = F.regexp_replace(out, pattern, to.replace("{", "").replace("}", ""))
    return F.trim(F.regexp_replace(out, r"^\n|\n$", ""))


def whole(canon: Column) -> Column:
    return F.trim(F.replace(canon, F.lit("\n"), F.lit(" ")))


def known(spark: SparkSession, texts: list[tuple[str, str]] | None = None) -> DataFrame:
    """digest, license_id, n_words, n_chars and head of the known texts: those given, or all of this module."""
    raw = spark.createDataFrame(texts if texts is not None else TEXTS + NOTICES, "license_id string, text string")
    rows = raw.select("license_id", whole(canonical(F.col("text"))).alias("t")).withColumn("words", F.split("t", " "))
    rows = rows.select(F.sha2("t", 256).alias("digest"), "license_id", F.size("words").alias("n_words"), F.length("t").alias("n_chars"), F.array_join(F.slice("words", 1, HEAD), " ").alias("head"))
    if texts is None:
        more = [(digest, name, n, size, head) for name, digest, n, size, head in DIGESTS]
        rows = rows.unionByName(spark.createDataFrame(more, rows.schema))
    return rows.groupBy("digest").agg(F.min("license_id").alias("license_id"), *(F.first(x).alias(x) for x in ("n_words", "n_chars", "head")))


def contained(canon: Column, texts: list) -> Column:
    """The digests of runs of words in the canonical text that begin a line with a known text's head, end a line, and
    have as many words as that text.

    The words are bound once a row. Of a line first its first word is looked at, then its head, and only runs as long
    as a text with that head are put together, so the work is in proportion to the text and the heads found in it."""
    none = F.array().cast("array<string>")
    if not texts:
        return none
    mark = "\u00b6"  # stands before the first word of each line
    heads: dict[str, set[int]] = {}
    for r in texts:
        heads.setdefault(r["head"], set()).add(r["n_words"])
    firsts = sorted({mark + head.split(" ")[0] for head in heads})
    sizes = F.create_map(*(x for head, n in sorted(heads.items()) for x in (F.lit(head), F.array(*map(F.lit, sorted(n))))))

    def runs(words: Column) -> Column:
        said = lambda i, n: F.replace(F.array_join(F.slice(words, i + 1, n), " "), F.lit(mark), F.lit(""))
        starts = F.filter(F.transform(words, lambda w, i: F.when(w.isin(firsts), i)), lambda i: i.isNotNull())
        ends = lambda i: F.coalesce(F.get(words, i).startswith(mark), F.lit(True))
        fits = lambda i, n: (i + n <= F.size(words)) & ends(i + n)
        known_sizes = lambda i: F.coalesce(F.try_element_at(sizes, said(i, HEAD)), F.array().cast("array<int>"))
        return F.flatten(F.transform(starts, lambda i: F.transform(F.filter(known_sizes(i), lambda n: fits(i, n)), lambda n: F.sha2(said(i, n), 256))))

    words = F.split(F.concat(F.lit(mark), F.replace(canon, F.lit("\n"), F.lit(" " + mark))), " ")
    found = F.get(F.transform(F.array(words), runs), F.lit(0))  # a lambda's variable: a column would be inlined into each use
    # Heads are letters, digits and spaces, so they are patterns as they stand.
    return F.when(whole(canon).rlike("|".join(sorted(heads))), found).otherwise(none)


def license_scan(docs: DataFrame, licences: DataFrame, most: int = 1_000) -> DataFrame:
    """One row per row of ``docs``: doc_id, text_license (of the entire text), notices (its lines that are known
    texts), contained (known texts of ``LEAST`` words or more in it), licenses (the identifiers of both in order,
    comma-separated; null if none), digest of the canonical text."""
    rows = licences.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"over {most} known texts")
    names = F.create_map(*(F.lit(x) for r in rows for x in (r["digest"], r["license_id"]))) if rows else F.create_map().cast("map<string,string>")
    name = lambda digests: F.filter(F.transform(digests, lambda d: F.try_element_at(names, d)), lambda x: x.isNotNull())
    # Only lines as long as a known text are hashed.
    sizes = sorted({r["n_chars"] for r in rows}) or [-1]
    lines = F.filter(F.transform(F.split("canon", "\n"), lambda x: F.trim(x)), lambda x: F.length(x).isin(sizes))
    canon = docs.select("doc_id", canonical(F.coalesce(F.col("text"), F.lit(""))).alias("canon"))
    found = canon.select(
        "doc_id", F.sha2(whole(F.col("canon")), 256).alias("digest"), name(F.transform(lines, lambda x: F.sha2(x, 256))).alias("lines"),
        name(contained(F.col("canon"), [r for r in rows if r["n_words"] >= LEAST])).alias("runs"),
    )
    entire = F.broadcast(licences.select("digest", F.col("license_id").alias("text_license")))
    all_names = F.array_sort(F.array_union("lines", "runs"))
    return found.join(entire, "digest", "left").select(
        "doc_id", "text_license", F.size("lines").cast("long").alias("notices"), F.size("runs").cast("long").alias("contained"),
        F.when(F.size(all_names) > 0, F.array_join(all_names, ",")).alias("licenses"), "digest",
    )
