"""Licence texts by canonical digest: whole texts are normalised and hash-joined to known licences."""

from __future__ import annotations

from importlib.resources import files

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Equivalent spellings, each with the one that stands for all.
SPELLINGS = [
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sublicence", "sublicense"), ("merchantibility", "merchantability"), ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"), ("authorisation", "authorization"), ("authorised", "authorized"), ("favour", "favor"), ("fulfil", "fulfill"), ("initialise", "initialize"), ("judgement", "judgment"),
    ("modernisation", "modernization"), ("organisation", "organization"), ("recognise", "recognize"), ("whilst", "while"), ("programme", "program"), ("http", "https"),
]

_WARRANTY = """{SOFTWARE} IS PROVIDED {BY}"AS IS"{AND} ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE {HOLDER} BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD_WARRANTY = _WARRANTY.replace("{SOFTWARE}", "THIS SOFTWARE").replace("{BY}", "BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS ").replace("{AND}", " AND").replace("{HOLDER}", "COPYRIGHT HOLDER OR CONTRIBUTORS")
_BSD_TERMS = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
#: Known whole texts, by SPDX name.  Titles and copyright lines fall away with the normalisation of both sides.
LICENCES = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause": _BSD_TERMS + _BSD_WARRANTY,
    "BSD-3-Clause": _BSD_TERMS + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n" + _BSD_WARRANTY,
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    "Unlicense": """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org>""",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "WTFPL": """DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE
Version 2, December 2004

Copyright (C) 2004 Sam Hocevar <sam@hocevar.net>

Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.

DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE
TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION

0. You just DO WHAT THE FUCK YOU WANT TO.""",
}
#: Notices that stand for a licence without being its text; known by names of their own.
NOTICES = {"GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3."}
#: The long ones are files named by SPDX, without -only and -or-later, which one text serves.
LICENCES |= {f.name.removesuffix(".txt"): f.read_text(encoding="utf-8") for f in sorted((files(__package__) / "licence_texts").iterdir(), key=lambda f: f.name) if f.name.endswith(".txt")}
LICENCES |= NOTICES

_TITLE = r"\A(the )?[a-z0-9.-]+( [a-z0-9.-]+){0,3} licen[cs]e( \([a-z0-9 .-]+\))?[ \t]*(\n|\z)"
#: (pattern, replacement) in order; they mean the same to Java's and to RE2's engine.  A line is a notice only if it
#: looks like one (the sign, a year or a blank to fill in), and a title only at the head: lines of a wrapped text begin
#: with "copyright" and end with "license" too.
STEPS = [
    (r"\r\n?", "\n"),
    (r"(?m)^[ \t/*#;-]*((copyright[ \t:]*(\(c\)|©|<|\[|\{|[0-9]{4})|copyright ([a-z.-]+,? ){1,4}((19|20)[0-9]{2}[ \t,.-]*)+$|\(c\)[ \t]*(copyright|<|\[|\{|[0-9]{4}|[^\n]*(19|20)[0-9]{2})|©)[^\n]*|all rights reserved[.]?[ \t]*)$", " "),
    (r"\A[^a-z0-9]+", ""),
    (_TITLE, ""),
    (r"\A[^a-z0-9]+", ""),
    (_TITLE, ""),
    (r"[^a-z0-9]+", " "),
]


def _steps(titles: bool) -> list[tuple[str, str]]:
    return [s for s in STEPS if titles or s[0] != _TITLE]


def canonical(text: Column, titles: bool = True) -> Column:
    """Lower case, without copyright and title lines, words of letters and digits with one space between, spellings made one."""
    out = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for pattern, new in _steps(titles):
        out = F.regexp_replace(out, pattern, new)
    out = F.concat(F.lit(" "), F.trim(out), F.lit(" "))
    for old, new in SPELLINGS:
        out = F.replace(out, F.lit(f" {old} "), F.lit(f" {new} "))
    return F.trim(out)


def canonical_sql(text: str, titles: bool = True) -> str:
    """The same in DuckDB's dialect."""
    out = f"translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    for pattern, new in _steps(titles):
        out = f"regexp_replace({out}, '{pattern}', '{new}', 'g')"
    out = f"' ' || trim({out}) || ' '"
    for old, new in SPELLINGS:
        out = f"replace({out}, ' {old} ', ' {new} ')"
    return f"trim({out})"


def known_digests(spark, licences: dict[str, str] | None = None) -> DataFrame:
    """``(digest, licence)`` of the known texts; texts with one canonical form share the first name.

    A text is known without its title and with it, as wrapping may join the title
    to the line below.
    """
    rows = list((LICENCES if licences is None else licences).items())
    table = spark.createDataFrame(rows, "licence string, body string")
    both = table.select("licence", F.explode(F.array(canonical(F.col("body")), canonical(F.col("body"), titles=False))).alias("form"))
    return both.select(F.sha2("form", 256).alias("digest"), "licence").groupBy("digest").agg(F.min("licence").alias("licence"))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", licences: dict[str, str] | None = None) -> DataFrame:
    """``(doc_id, digest string, licence string)``, one row for each document.

    ``digest`` is the SHA-256 of the whole canonical text and ``licence`` the
    known licence with that digest, or null.  Null texts count as empty; an empty
    text is no licence; texts are taken whole; repeated rows give repeated
    results; an empty table gives no rows; other columns are not read.

    The known digests are a constant of this module or an argument that the
    driver already holds, so broadcasting them is bounded; documents stay where
    they are.
    """
    known = known_digests(docs.sparkSession, licences).where(F.col("digest") != F.sha2(F.lit(""), 256))
    hashed = docs.select(F.col(doc_id).alias("doc_id"), F.sha2(canonical(F.coalesce(F.col(text), F.lit(""))), 256).alias("digest"))
    return hashed.join(F.broadcast(known), "digest", "left").select("doc_id", "digest", "licence")
