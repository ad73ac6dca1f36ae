"""License scans by canonical digests.

A text is brought to a canonical form (case, punctuation, white space, copyright statements, a known
title line, equivalent spellings, names of holders in the clauses that have a place for one, the publisher's address), its SHA-256 is joined with the digests of known licence texts, and each of its lines that speaks of a
licence is looked up among the digests of known notices. Only these constant tables are broadcast.

Defined cases: null and empty texts have the digest of the empty text and no licence; a text that is just
copyright lines has an empty canonical form; repeated rows give equal results; a notice that occurs in
several lines is reported once; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from itertools import islice
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import computed, table

# Spellings that licence matching treats as the same (found, canonical).
SPELLINGS = [
    ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"),
    ("analyse", "analyze"),
    ("artefact", "artifact"),
    ("authorisation", "authorization"),
    ("authorised", "authorized"),
    ("calibre", "caliber"),
    ("cancelled", "canceled"),
    ("catalogue", "catalog"),
    ("centre", "center"),
    ("favour", "favor"),
    ("favourite", "favorite"),
    ("fulfil", "fulfill"),
    ("fulfilment", "fulfillment"),
    ("judgement", "judgment"),
    ("labour", "labor"),
    ("licence", "license"),
    ("merchantibility", "merchantability"),
    ("non commercial", "noncommercial"),
    ("organisation", "organization"),
    ("per cent", "percent"),
    ("recognise", "recognize"),
    ("sub license", "sublicense"),
    ("whilst", "while"),
    ("wilful", "willful"),
]
_LICENSE = re.compile("licen[cs]e", re.I)
_WORDS = "|".join(a for a, _ in SPELLINGS)

# The texts of known licences.
TEXTS = {
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "0BSD": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
}
# Last lines with which a licence is published as well as without.
TAILS = {"Unlicense": [" For more information, please refer to <http://unlicense.org/>", " For more information, please refer to <https://unlicense.org/>"]}
# Title lines of the published texts, in canonical form.
TITLES = {
    "mit license", "the mit license", "the mit license mit", "mit license mit", "expat license",
    "isc license", "the isc license", "isc license isc",
    "bsd zero clause license", "zero clause bsd", "zero clause bsd license", "bsd zero clause license 0bsd",
    "bsd 2 clause license", "the 2 clause bsd license", "simplified bsd license", "bsd 2 clause simplified license",
    "zlib license", "the zlib license", "the zlib libpng license", "zlib libpng license",
    "the unlicense", "unlicense",
}
# Lines that state a licence.
NOTICES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Released under the Apache License, Version 2.0."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under CC BY-NC 4.0."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 3."],
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License."],
}


# The clause that makes the three-clause BSD licence of the two-clause one.
_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
TEXTS["BSD-3-Clause"] = TEXTS["BSD-2-Clause"].replace("THIS SOFTWARE IS PROVIDED", _THIRD + "THIS SOFTWARE IS PROVIDED", 1)
# Long texts are files of the licence's name.
TEXTS |= {p.stem: p.read_text(encoding="utf-8") for p in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))}
# What ends the terms; they are also given without what follows, and without this line.
ENDS = ["END OF TERMS AND CONDITIONS", "Exhibit A - Source Code Form License Notice", "EXHIBIT A -Mozilla Public License.", "ADDENDUM: How to use this License for your documents", "The End\n"]
for _name, _text in TEXTS.items():
    for _end in ENDS:
        if _end in _text:
            TEXTS[_name], _, _rest = _text.partition(_end)
            TAILS[_name] = [_end, _end + _rest]
# The notice that Apache's appendix gives for a work stands for the licence.
_NOTICE = "Licensed under the Apache License"
ALSO = {"Apache-2.0": [_NOTICE + TAILS["Apache-2.0"][1].partition(_NOTICE)[2]]}
TITLES |= {"bsd 3 clause license", "the 3 clause bsd license", "bsd 3 clause new or revised license", "new bsd license", "modified bsd license", "the bsd 3 clause license"}


# A statement names a year, a sign or a holder; these words after 'copyright' are a licence body's instead.
_BODY = r"(?:notices?|holders?|owners?|laws?|licen[cs]es?|interests?|statements?|protection|rights?|and|or|in|of|to|is|are|as|for|on|shall|may|if|the\s+above)\b"
# Openings of licences and notices, where a statement on the same line ends.
_OPENINGS = "|".join(sorted({r"\W+".join(re.findall(r"\w+", t)[:3]) for t in [*TEXTS.values(), *(x for n in NOTICES.values() for x in n)]}))
COPYRIGHT = rf"(?im)^[^\w\n]*(?:copyright[^\w\n]*(?:\(c\)|©|\d{{4}}\b|[<\[{{])|copyright[ \t]*:?[ \t]+(?!{_BODY})\w|©|\(c\)[^\w\n]*(?:copyright\b|\d{{4}}\b)|all rights reserved\b)[^\n]*?(?=\b(?:{_OPENINGS})\b|$)"

_COPYRIGHT, _BREAK, _WORD, _SPELL, _SPELLED = re.compile(COPYRIGHT), re.compile(r"[\W_]+"), re.compile(r"[^\W_]+"), re.compile(rf"\b(?:{_WORDS})\b"), dict(SPELLINGS)


# Wordings, in plain form, in which holders put their names or for which others are usual.
WORDINGS = [
    (r"\bneither the names? of (?:\w+ ){1,16}?n?or the names of (?:(?:its|any|other|their|the) )*contributors\b", "neither the name of the copyright holder nor the names of its contributors"),
    (r"\bthis software is provided by (?:\w+ ){1,12}?and contributors as is\b", "this software is provided by the copyright holders and contributors as is"),
    (r"\bin no event shall (?:\w+ ){1,12}?or contributors be liable\b", "in no event shall the copyright holder or contributors be liable"),
    (r"\b\d+ (?:temple place(?: suite \d+)?|franklin st(?:reet)?(?: \w+ floor)?|mass ave) (?:boston|cambridge) ma \d{5}(?: \d{4})?(?: usa)?\b", ""),
    (r"\bhttps ", "http "),
]
_WORDINGS = [(re.compile(a), b) for a, b in WORDINGS]
_LONGEST = max(len(t.split()) for t in TITLES)


def _plain(text: str) -> str:
    out = _SPELL.sub(lambda m: _SPELLED[m[0]], _BREAK.sub(" ", text.lower())).strip()
    for pattern, by in _WORDINGS:
        out = pattern.sub(by, out)
    return out.replace("  ", " ").strip()


def _titled(line: str) -> bool:
    words = [m[0] for m in islice(_WORD.finditer(line), _LONGEST + 1)]
    return len(words) <= _LONGEST and _plain(" ".join(words)) in TITLES


def canonical(text: str) -> str:
    t = _COPYRIGHT.sub(" ", text).lstrip()
    title, _, rest = t.partition("\n")
    if _titled(title):
        return _plain(_COPYRIGHT.sub(" ", rest)) or _plain(title)
    return _plain(t)


def digest(text: str) -> str:
    return hashlib.sha256(canonical(text).encode()).hexdigest()


def known_digests() -> dict[str, str]:
    """Digest to licence: each text with its known tails, and lists of clauses also with bullets in place of numbers."""
    out = {digest(t): k for k, ts in ALSO.items() for t in ts}
    for k, t in TEXTS.items():
        for tail in ("", *TAILS.get(k, ())):
            out[digest(t + tail)] = k
            if k.startswith("BSD-"):
                out[digest(re.sub(r"\b[1-3]\. ", "* ", t + tail))] = k
    return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, digest, license_id, notices): the licence that the whole text is, and those its lines name."""
    spark = docs.sparkSession
    known = F.broadcast(spark.createDataFrame(sorted(known_digests().items()), "digest string, license_id string"))
    notice = {digest(t): k for k, ts in NOTICES.items() for t in ts}

    def digests(texts: list) -> dict:
        texts = [t or "" for t in texts]
        lines = [[digest(x) for x in t.split("\n") if _LICENSE.search(x)] if _LICENSE.search(t) else [] for t in texts]
        return {"digest": [digest(t) for t in texts], "notices": [",".join(sorted({notice[x] for x in found if x in notice})) for found in lines]}

    d = computed(docs, [F.col(id_col)], F.col(text_col), digests, [("digest", "string"), ("notices", "string")])
    return d.join(known, "digest", "left").select(id_col, "digest", "license_id", "notices")


def op9_license_scans(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
