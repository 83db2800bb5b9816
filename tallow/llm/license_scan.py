"""Licence scan by canonical digest: whole texts are brought to one spelling and hash-joined to known licences.

Canonical form: lines that state a copyright dropped (the word with a sign, a year or a name; not a clause that a line
break happens to begin with it); A-Z lowered; typographic marks and punctuation turned to spaces; words of equivalent
spelling, each by itself, brought to one; "all rights reserved" dropped; white space collapsed; a title before the text
dropped; SHA-256. So wrapping, case, title and holder do not matter.

Known licences are a parameter: a table (license, text) of any size, a mapping of names to texts, or, by default, KNOWN
(short texts, given as plain text) and DIGESTS (of longer published texts in canonical form). Up to MOST_KNOWN of them
are broadcast; a larger table is joined by a shuffle.

Defined cases: null text and text that is empty in canonical form have a digest but match nothing; null ids and
repeated rows are scanned like any other; of names with one digest the first in order counts; an empty table gives an
empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallow.llm.common import LOWER, UPPER, ascii_lower

MOST_KNOWN = 2000

# Spellings held equal (as in the public licence matching guidelines).
EQUIVALENT = {
    "acknowledgement": "acknowledgment",
    "analogue": "analog",
    "authorised": "authorized",
    "cancelled": "canceled",
    "centre": "center",
    "favour": "favor",
    "fulfilment": "fulfillment",
    "judgement": "judgment",
    "licence": "license",
    "licences": "licenses",
    "licenced": "licensed",
    "modelled": "modeled",
    "noncommercial": "non commercial",
    "noninfringement": "non infringement",
    "organisation": "organization",
    "programme": "program",
    "recognise": "recognize",
    "sublicense": "sub license",
    "sublicence": "sub license",
    "utilise": "utilize",
    "whilst": "while",
    "wilful": "willful",
    "https": "http",
}

# The wording of known licences and notices.
KNOWN = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "MIT-notice": "Released under the MIT License.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "Unlicense": """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org>""",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
}
_CLAUSE_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\nTHIS SOFTWARE IS PROVIDED"
KNOWN["BSD-3-Clause"] = KNOWN["BSD-2-Clause"].replace("THIS SOFTWARE IS PROVIDED", _CLAUSE_3)

# SHA-256 of published licence texts in canonical form.
DIGESTS = {
    "Apache-2.0": "ce3d065bbb28d22a4ad074ba349648c7e35a5730bac8e7b232ccc27c7a1a4292",
    "Artistic-1.0-Perl": "de5e8896b763918701eb91e7bf8bf81f20a97c9f8dd1cacc44519e47d3462bf8",
    "CC0-1.0": "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f",
    "GFDL-1.2": "610a138d87da06825fd88410f8b5de6e6d73095bf2cce810bd5b4d0941534083",
    "GFDL-1.3": "b5e307004380d05e7d0e039a9c4d1f3c7c3da7c81fa630832109ba92f6f1a962",
    "GPL-1.0": "160c74cee4013ca5418bd3648b4e205c6e0d38b5507407deffe7f5a5a9f31b60",
    "GPL-2.0": "652aa03b0e13f5393ad2f49e9e203ef509d88747d904ab36b7ff23bc92c4a6f6",
    "GPL-3.0": "eaab5d82fdcca441d83a1913bbf07e4de3a739e190578c0bffde24f84e93bb2a",
    "LGPL-2.0": "5df277a264b0db9f656dea052fa76d8fbe46620768b01b8f09f76ef719771d95",
    "LGPL-2.1": "659bfcbba21e743ae02dd4d5518f6bf275275dfe701b5ff9c9b8d21e24d85589",
    "LGPL-3.0": "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be",
    "MPL-1.1": "ec5bd85582a69186eee2d91f20186129548548639c60c722d4023f82bd532a0e",
    "MPL-2.0": "337e493975eeb4f3c7097a25848f071b472ebbc1e4e9f950e4b985ee4d0aa17a",
}

_STATED = r"(^|\n)[ \t/*#;>-]*(([Cc]opyright|COPYRIGHT)[ \t]+(\([cC]\)|©|[0-9]{4}|<year>|\[year\]|\[yyyy\]|by [A-Z]|[A-Z][a-z])|\([cC]\)[ \t]+|©)[^\n]*"
_JUNK = r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f\xa0©®™‘’“”–—…·•]+"
_TITLE = "^(the )?((mit|isc|x11|zlib|boost software) license( mit)?|(bsd [234] clause|bsd zero clause|0bsd)( new or revised| simplified| original)? license|unlicense) "
#: Every word has two spaces of its own, one on either side, so that neighbours are told apart.
_WORDS = [(f" {old} ", f" {new.replace(' ', '  ')} ") for old, new in EQUIVALENT.items()] + [(" all  rights  reserved ", "")]


def canonical(text: Column) -> Column:
    t = ascii_lower(F.regexp_replace(text, _STATED, "$1"))
    t = F.concat(F.lit(" "), F.regexp_replace(t, _JUNK, "  "), F.lit(" "))
    for old, new in [*_WORDS, ("  ", " ")]:
        t = F.replace(t, F.lit(old), F.lit(new))
    return F.regexp_replace(F.trim(t), _TITLE, "")


def canonical_text(text: str) -> str:
    """The same in Python, for the known texts and for tests."""
    t = re.sub(_STATED, r"\1", text).translate(str.maketrans(UPPER, LOWER))
    t = " " + re.sub(_JUNK, "  ", t) + " "
    for old, new in [*_WORDS, ("  ", " ")]:
        t = t.replace(old, new)
    return re.sub(_TITLE, "", t.strip(" "))


def digests(known: dict[str, str] | None = None) -> list[tuple[str, str]]:
    """(digest, license) of texts, or of those known by default."""
    texts = KNOWN if known is None else known
    named = [(k, hashlib.sha256(canonical_text(t).encode()).hexdigest()) for k, t in texts.items() if canonical_text(t)]
    found = {d: k for k, d in sorted([*named, *(DIGESTS.items() if known is None else ())], reverse=True)}
    return sorted(found.items())


def _table(spark: SparkSession, known: dict[str, str] | DataFrame | None) -> DataFrame:
    if not isinstance(known, DataFrame):
        rows = digests(known)
        table = spark.createDataFrame(rows, "digest string, license string")
        return F.broadcast(table) if len(rows) <= MOST_KNOWN else table
    text = canonical(F.coalesce(F.col("text").cast("string"), F.lit("")))
    rows = known.select(text.alias("_text"), F.col("license").cast("string").alias("license")).where("_text <> '' AND license IS NOT NULL")
    table = rows.groupBy(F.sha2("_text", 256).alias("digest")).agg(F.min("license").alias("license"))
    return F.broadcast(table) if known.limit(MOST_KNOWN + 1).count() <= MOST_KNOWN else table.hint("shuffle_hash")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", known: dict[str, str] | DataFrame | None = None) -> DataFrame:
    """One row per document: (doc_id, digest, license, matched)."""
    text = canonical(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))
    rows = docs.select(F.col(f"`{id_col}`").alias(id_col), F.sha2(text, 256).alias("digest"))
    return rows.join(_table(docs.sparkSession, known), "digest", "left").select(id_col, "digest", "license", F.col("license").isNotNull().alias("matched"))


def _sql() -> str:
    quote = lambda s: s.replace("'", "''")
    t = f"translate(regexp_replace(coalesce(text, ''), '{quote(_STATED)}', '\\1', 'g'), '{UPPER}', '{LOWER}')"
    t = f"' ' || regexp_replace({t}, '{_JUNK.replace(chr(92) + 'xa0', chr(92) + 'x{a0}')}', '  ', 'g') || ' '"
    for old, new in [*_WORDS, ("  ", " ")]:
        t = f"replace({t}, '{old}', '{new}')"
    rows = ", ".join(f"('{d}', '{quote(k)}')" for d, k in digests())
    return f"WITH k(digest, license) AS (VALUES {rows}), c AS (SELECT doc_id, sha256(regexp_replace(trim({t}, ' '), '{_TITLE}', '')) AS digest FROM documents) SELECT doc_id, digest, license, license IS NOT NULL AS matched FROM c LEFT JOIN k USING (digest)"


SQL = _sql()
