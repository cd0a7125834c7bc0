"""License scans by canonical digest.

A text is normalised (lower case; copyright lines gone; equivalent spellings made one; punctuation and white space to
single spaces) and hashed, and the digests of entire texts are joined to those of known licences. The known table is
a constant of this module, or one the caller gives, and only a counted table is broadcast.

Native DataFrame functions, map-only but for the join.

Defined results: a null text counts as empty, a text that normalises to nothing matches no licence, repeated rows repeat, two
known licences with one digest give the first by name, an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import small, text_of

#: Pattern and replacement, in order, after lower-casing. They mean the same to Java, Python and RE2.
STEPS = (
    ("\r\n?", "\n"),
    ("(?m)^[ \\t#*/;%-]*(?:copyright|\\(c\\)|\u00a9)[^\n]*$", ""),
    ("(?m)^[ \\t#*/;%-]*all rights reserved\\.?[ \\t]*$", ""),
    ("\\(c\\)|\u00a9", "copyright"),
    ("https://", "http://"),
    ("[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F\u00a0\u2010-\u2015\u2018-\u201f\u2026]+", " "),
)
#: Words that count as equal, from the public matching guidelines for licences.
SPELLINGS = (
    ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"),
    ("analyse", "analyze"),
    ("artefact", "artifact"),
    ("authorisation", "authorization"),
    ("authorised", "authorized"),
    ("cancelled", "canceled"),
    ("catalogue", "catalog"),
    ("centre", "center"),
    ("emphasised", "emphasized"),
    ("favour", "favor"),
    ("favourite", "favorite"),
    ("fulfil", "fulfill"),
    ("fulfilment", "fulfillment"),
    ("initialise", "initialize"),
    ("judgement", "judgment"),
    ("labelled", "labeled"),
    ("labour", "labor"),
    ("licence", "license"),
    ("maximise", "maximize"),
    ("modelled", "modeled"),
    ("offence", "offense"),
    ("optimise", "optimize"),
    ("organisation", "organization"),
    ("organise", "organize"),
    ("practise", "practice"),
    ("programme", "program"),
    ("realise", "realize"),
    ("recognise", "recognize"),
    ("signalling", "signaling"),
    ("sub license", "sublicense"),
    ("sub licence", "sublicense"),
    ("utilisation", "utilization"),
    ("whilst", "while"),
    ("wilful", "willful"),
    ("non commercial", "noncommercial"),
    ("per cent", "percent"),
    ("copyright owner", "copyright holder"),
)
_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. '
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_PERMISSION = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, '
    "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
)
_ISC = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n"
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n"
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n"
)
_BSD3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
_BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. '
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
#: Public licence texts without their copyright lines, and one-line notices as whole texts.
KNOWN = (
    ("MIT", f"MIT License\n\n{_PERMISSION}, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n{_WARRANTY}"),
    ("MIT", f"{_PERMISSION}, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n{_WARRANTY}"),
    ("MIT-0", f"MIT No Attribution\n\n{_PERMISSION}.\n\n{_WARRANTY}"),
    ("ISC", f"ISC License\n\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n{_ISC}"),
    ("ISC", f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n{_ISC}"),
    ("0BSD", f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\n{_ISC}"),
    ("BSD-2-Clause", f"{_BSD}\n{_BSD_END}"),
    ("BSD-2-Clause", f"BSD 2-Clause License\n\n{_BSD}\n{_BSD_END}"),
    ("BSD-3-Clause", f"{_BSD}{_BSD3}\n{_BSD_END}"),
    ("BSD-3-Clause", f"BSD 3-Clause License\n\n{_BSD}{_BSD3}\n{_BSD_END}"),
    ("MIT notice", "Released under the MIT License."),
    ("Apache-2.0 notice", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0 notice", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0 notice", "Licensed under CC BY-NC 4.0."),
)
#: Licences by the digests of their canonical full texts; those with an appendix after their terms also without it.
FULL = (
    ("Apache-2.0", "ebc600199db9838b4fc2d5288a12598c2702142177a89b3443f5cc87b137d94b"),
    ("Apache-2.0", "98378616989e23431b15181388a001fdeac0999db741918e302c5162392bcfbd"),
    ("Apache-2.0", "23c0498e738b86da84fa1ffb1ff43f4ef103f365367077ada18cd1db1813d6da"),
    ("Artistic-1.0-Perl", "cc2cd6cccfacd5fb622fb0e9b9a373fa9dcb86a8c152213a2b856dfbe24fe304"),
    ("BSD-3-Clause", "21ce5e311a0ef74591e636cf6d0a236029bcaa0ee86324ac68d5748657aa8651"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2", "37db86be8f16e9b8dfb0d63e1698ad2e07d54f312494c1cb2dbdb4fa37487f0f"),
    ("GFDL-1.3", "7befa86e5ee53162018d597eee81db6c727f3e64fab4641af93e19deab1807b4"),
    ("GPL-1.0", "490a17f9c44b8e7737e6d5b52eebf4c3610f67ee98c4ad515329fa012eebe42d"),
    ("GPL-1.0", "6375a768fd262bf5281905a9585411d2d0fb4ea15cb08cfcba49f73fedb82abc"),
    ("GPL-1.0", "89f75ffda938e788be38679f9f83e317c2a03398fccf03ee60505d44d1bf9f70"),
    ("GPL-2.0", "b45f95d8277a4c920f37dd2e6bd0bfe7a28fc0622b3328e8a50b73e64eb55b33"),
    ("GPL-2.0", "e4d14510e41435c3eb12c255b72546a3cb9943f06f209c72bc30a19095b08999"),
    ("GPL-2.0", "a1e7ba14d8d85807f384435b77f91e925decc43da128311c991c4f2337e44017"),
    ("GPL-3.0", "fa71ec4a6c569a525cb1978408e8bf3be98bac8c347730082699237b42aa30ba"),
    ("GPL-3.0", "3dcf77ad8c25248618918aaff1de8a2cb80cea6ca922ef4a7a389cca96a7560b"),
    ("GPL-3.0", "3d4de016a08e1d98b27dec755cdf4530b92807d97aaa185b32e12d52942b1943"),
    ("LGPL-2.0", "9b0b3105b96203f9d9e4b72d4b77951152156c88139302b5aedf6295e3ceaaa3"),
    ("LGPL-2.0", "ff773d8d898dfc51ae2dbf3baa20700673e8ceb153b13d26c525af34a59adf0c"),
    ("LGPL-2.0", "e0de5033b5ad2a24c0a1a8b04f09e33038ffa62d2bef7178de2a3c6f5d56f499"),
    ("LGPL-2.1", "cb225061bb71741fe8b31a2092e22fe05b1130438158ae5d16c48fd50186e345"),
    ("LGPL-2.1", "963f79d48038eed98d8341c84d8d3b765e99508a738d00654c0112f70a7c370c"),
    ("LGPL-2.1", "9bf9c99aeafbdbccd7456a00d574699e3deb41868375496cacbf170be719bebd"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "e589f4b022b6b84ad31536a60e2ea27b9ca3e95809a7bfeb95b093dd33472c3a"),
    ("MPL-2.0", "95f6a0d094cf3da6a140310541c7b576789031b600469b70877b34f97918e4c9"),
)
#: Texts of KNOWN without a title, and the further titles that they are common under.
TITLED = tuple(
    (name, f"{title}\n\n{KNOWN[at][1]}")
    for name, at, titles in (
        ("MIT", 1, ("The MIT License (MIT)", "The MIT License", "MIT License (MIT)")),
        ("ISC", 4, ("The ISC License", "ISC License (ISC)", "The ISC License (ISC)")),
        ("0BSD", 5, ("BSD Zero Clause License", "Zero-Clause BSD", "Zero Clause BSD License")),
        ("BSD-2-Clause", 6, ("The 2-Clause BSD License", 'BSD 2-Clause "Simplified" License', "Simplified BSD License")),
        ("BSD-3-Clause", 8, ("The 3-Clause BSD License", 'BSD 3-Clause "New" or "Revised" License', "New BSD License")),
    )
    for title in titles
)


def _steps() -> list[tuple[str, str]]:
    return [*STEPS, *((f"\\b{a}\\b", b) for a, b in SPELLINGS)]


def canonical(text: str) -> str:
    """The normal form, in Python."""
    text = text.lower()
    for pattern, to in _steps():
        text = re.sub(pattern, to, text, flags=re.ASCII)
    return text.strip(" ")


def canonical_column(text: Column) -> Column:
    """The normal form, as a column. Spellings are replaced only where their stems occur."""
    text = F.lower(text)
    for pattern, to in STEPS:
        text = F.regexp_replace(text, pattern, to)
    text = F.trim(text)
    out = text
    for a, b in SPELLINGS:
        out = F.regexp_replace(out, f"\\b{a}\\b", b)
    return F.when(text.rlike("\\b(?:" + "|".join(a for a, _ in SPELLINGS) + ")\\b"), out).otherwise(text)


def digests(known: tuple[tuple[str, str], ...] = KNOWN) -> dict[str, str]:
    """Digest to licence."""
    out: dict[str, str] = {}
    for name, text in sorted(known):
        out.setdefault(hashlib.sha256(canonical(text).encode()).hexdigest(), name)
    return out


def known_table(spark: SparkSession, known: tuple[tuple[str, str], ...] | None = None) -> DataFrame:
    """(digest, license) of the texts given, or of all that this module knows."""
    found = digests(known) if known is not None else {d: n for n, d in FULL} | digests(KNOWN + TITLED)
    return spark.createDataFrame(list(found.items()), "digest string, license string")


def scan(docs: DataFrame, known: DataFrame | None = None, text: str = "text") -> DataFrame:
    """docs with license_digest and license (null if its text is none that is known); known: (digest, license)."""
    known = known_table(docs.sparkSession) if known is None else known.groupBy("digest").agg(F.min("license").alias("license"))
    own = [F.col(f"`{c}`") for c in docs.columns]
    hashed = docs.select(*own, F.sha2(F.encode(canonical_column(text_of(f"`{text}`")), "utf-8"), 256).alias("license_digest"))
    table = small(known.select(F.col("digest").alias("__digest"), F.col("license").alias("license")))
    return hashed.join(table, F.col("license_digest") == F.col("__digest"), "left").drop("__digest")


def sql() -> str:
    """The scan of documents in DuckDB."""
    out = "lower(coalesce(text, ''))"
    quote = lambda x: x.replace("'", "''")
    chars = lambda p: "".join(c if ord(c) > 31 else f"\\x{ord(c):02X}" for c in p)
    for k, (pattern, to) in enumerate(_steps()):
        if k == len(STEPS):
            out = f"trim({out}, ' ')"
        to = "' '" if to == " " else "chr(10)" if to == "\n" else f"'{quote(to)}'"
        out = f"regexp_replace({out}, '{quote(chars(pattern))}', {to}, 'g')"
    rows = ", ".join(f"('{d}', '{quote(n)}')" for d, n in digests().items())
    return f"WITH known(digest, license) AS (VALUES {rows}), d AS (SELECT doc_id, sha256({out}) AS license_digest FROM documents) SELECT doc_id, license_digest, license FROM d LEFT JOIN known ON digest = license_digest"
