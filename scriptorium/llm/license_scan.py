"""Licence scans by canonical digests, by DataFrame functions alone.

A text is brought into a canonical form: lower case, copyright lines dropped,
equivalent spellings made one, all but letters and digits turned into single
spaces. The SHA-256 of the whole canonical text is hash-joined to the digests
of known licences, a literal table whose size doesn't depend on the data: short
licences by their texts, long ones by their digests, and whatever texts the
caller adds.
Beside this, lines that name a licence are looked up in the digests of known
one-line notices.

Defined cases: null, empty and blank texts have the digest of the empty text and no
licence; repeated rows are each looked up; an empty table gives an empty
result; columns besides ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Licence texts as published by the Open Source Initiative.
_MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
_ISC_END = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_1 = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BSD_2 = "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_3 = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'

LICENCES = {
    "MIT": [_MIT_GRANT, "MIT License\n\n" + _MIT_GRANT, "The MIT License (MIT)\n\n" + _MIT_GRANT],
    "ISC": [_ISC_GRANT + "\n\n" + _ISC_END, "ISC License\n\n" + _ISC_GRANT + "\n\n" + _ISC_END],
    "BSD-2-Clause": [f"{head}{_BSD_HEAD}\n\n{a}{_BSD_1}\n\n{b}{_BSD_2}\n\n{_BSD_END}" for head in ("", "BSD 2-Clause License\n\n") for a, b in (("1. ", "2. "), ("", ""))],
    "BSD-3-Clause": [f"{head}{_BSD_HEAD}\n\n{a}{_BSD_1}\n\n{b}{_BSD_2}\n\n{c}{_BSD_3}\n\n{_BSD_END}" for head in ("", "BSD 3-Clause License\n\n") for a, b, c in (("1. ", "2. ", "3. "), ("", "", ""))],
}

# SHA-256 of the canonical form of long licence texts, as their publishers give them out.
LONG_TEXTS = {
    "Apache-2.0": ["0be25ae8b112b6c47bf696a745855eebba678079747ad8bbf877d928555027f1"],
    "Artistic-1.0-Perl": ["e963bc30f4d3c45f45030c34409ee37315564625649c1394e32bb5ddd99e01b2"],
    "CC0-1.0": ["96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"],
    "GFDL-1.2": ["5379e6f33e826ba185b23fd11a414555c2161fda481478babd1e73a3ae098a71"],
    "GFDL-1.3": ["93d6108daecdddc5f284cf8f2512fb0d72f6e9ee12381feb9704ba194b00c3e6"],
    "GPL-1.0": ["ec8a6b7d70e9f225b63d3962ed5b4721373f5535d7b967a06722b0d621f6892a"],
    "GPL-2.0": ["331b500eb3c5ee796906547305df82fff4a35b3aa03c1d3ea84d32078292b2e6"],
    "GPL-3.0": ["a8cd54d6683aa630f0b8d05d56184ad91dc486756da2df61c94d3e4e8d5ecb68"],
    "LGPL-2.0": ["61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908"],
    "LGPL-2.1": ["4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891"],
    "LGPL-3.0": ["aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"],
    "MPL-1.1": ["fbe9a0b96f52e03cb474f9a7083781399c011279e85b548118563ec96e659354"],
    "MPL-2.0": ["95f6a0d094cf3da6a140310541c7b576789031b600469b70877b34f97918e4c9"],
}

# One-line notices.
NOTICES = {
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", "SPDX-License-Identifier: MIT"],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", 'Licensed under the Apache License, Version 2.0 (the "License").', "SPDX-License-Identifier: Apache-2.0"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0-only"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "SPDX-License-Identifier: CC-BY-4.0"],
}

# Spellings that count as equal, after lower-casing.
SPELLINGS = {
    "organisation": "organization",
    "merchantibility": "merchantability",
    "noncommercial": "non commercial",
    "copyright owner": "copyright holder",
    "copyright owners": "copyright holders",
    "non-infringement": "noninfringement",
}


def canonical(text: Column) -> Column:
    """The canonical form. Lines that begin with a copyright sign or the word
    and then a sign or year, and "all rights reserved" lines, are dropped."""
    out = F.lower(F.coalesce(text, F.lit("")))
    out = F.regexp_replace(out, r"(?m)^[^\S\n]*(?:copyright[^\S\n]*(?:\(c\)|©|[0-9]{4})|\(c\)|©|all rights reserved)[^\n]*$", " ")
    out = F.regexp_replace(out, "licenc(?=e|ing|or)", "licens")
    for short, full in sorted(SPELLINGS.items(), key=lambda x: -len(x[0])):
        out = F.regexp_replace(out, rf"\b{short}\b", full)
    out = F.regexp_replace(out, r"[^\p{L}\p{N}]+", " ")
    return F.trim(out)


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def _known(docs: DataFrame, texts: dict[str, list[str]]) -> DataFrame:
    rows = [(k, t) for k, versions in texts.items() for t in versions]
    table = docs.sparkSession.createDataFrame(rows, "license string, known_text string")
    return table.select("license", digest(F.col("known_text")).alias("known_digest")).distinct()


def _notice_digests(docs: DataFrame) -> list[tuple[str, str]]:
    return sorted((r["known_digest"], r["license"]) for r in _known(docs, NOTICES).collect())


def _licences(docs: DataFrame, more: dict[str, list[str]] | None) -> DataFrame:
    """license, known_digest, one row of a digest."""
    long = [(k, d) for k, digests in LONG_TEXTS.items() for d in digests]
    texts = _known(docs, {k: [*LICENCES.get(k, []), *(more or {}).get(k, [])] for k in {**LICENCES, **(more or {})}})
    both = texts.union(docs.sparkSession.createDataFrame(long, "license string, known_digest string"))
    return both.groupBy("known_digest").agg(F.min("license").alias("license"))


def scan(docs: DataFrame, more: dict[str, list[str]] | None = None) -> DataFrame:
    """doc_id, text_digest, license (of the whole text, else null), notices (licences of notice lines, sorted); more has further texts by licence."""
    notices = _notice_digests(docs)
    digests = F.array(*[F.lit(d) for d, _ in notices])
    names = F.array(*[F.lit(n) for _, n in notices])
    lines = F.filter(F.split(F.coalesce(F.col("text"), F.lit("")), "\n"), lambda x: x.rlike("(?i)licen[sc]|spdx"))
    places = F.transform(lines, lambda x: F.array_position(digests, digest(x)))
    found = F.transform(F.filter(places, lambda p: p > 0), lambda p: F.element_at(names, p.cast("int")))
    rows = docs.select("doc_id", digest(F.col("text")).alias("text_digest"), F.array_sort(F.array_distinct(found)).alias("notices"))
    known = F.broadcast(_licences(docs, more))
    return rows.join(known, rows["text_digest"] == known["known_digest"], "left").select("doc_id", "text_digest", "license", "notices")
