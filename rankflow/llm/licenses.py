"""Licence scans by canonical digests.  SQL functions only.

A text is brought to a canonical form: lower case, lines that are only a copyright notice dropped, equivalent spellings made one,
everything but letters and digits a single space.  Its SHA-256 is looked up among the digests of known licences by a hash join.
Whole documents are looked up as licence texts, and their single lines as licence notices.  The known texts are few and fixed, so their
table is broadcast; lines are looked up in place.  Nothing is shuffled.

Edge cases: null, empty and blank texts match nothing and have a null digest; every row is scanned for itself, whatever its id.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Public licence texts, without titles where these vary, and short notices.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
_UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""
KNOWN = {
    "MIT": [_MIT, "MIT License\n\n" + _MIT, "The MIT License\n\n" + _MIT],
    "ISC": [_ISC, "ISC License\n\n" + _ISC],
    "BSD-2-Clause": ["\n\n".join((_BSD_HEAD, _BSD_TAIL)), "\n\n".join(("BSD 2-Clause License", _BSD_HEAD, _BSD_TAIL))],
    "BSD-3-Clause": ["\n\n".join((_BSD_HEAD, _BSD_THIRD, _BSD_TAIL)), "\n\n".join(("BSD 3-Clause License", _BSD_HEAD, _BSD_THIRD, _BSD_TAIL))],
    "Unlicense": [_UNLICENSE, _UNLICENSE + "\n\nFor more information, please refer to <http://unlicense.org/>", _UNLICENSE + "\n\nFor more information, please refer to <https://unlicense.org>"],
    "Zlib": [_ZLIB, "zlib License\n\n" + _ZLIB],
}
# SHA-256 of the canonical form of whole public licence texts, as operating systems ship them.
DIGESTS = {
    "Apache-2.0": "ef36af97727268b60fb709836c24580bed9887f649dba6f0fd9ef4b18232fd25",
    "Artistic-1.0-Perl": "e963bc30f4d3c45f45030c34409ee37315564625649c1394e32bb5ddd99e01b2",
    "CC0-1.0": "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f",
    "GFDL-1.2": "452eaadd998b06b62a51be424c021eea5228803a2773e147818b9cd429a60d64",
    "GFDL-1.3": "c6db6132e3f9cfc574a0348860b9e8a36b70ab711ca7ec85d9c61871c2d90e55",
    "GPL-1.0": "eafda7cb5e995143f4d45ef2107eb160d6856afabed7c48b1b317303bc40a7e6",
    "GPL-2.0": "633db8412bbb99b0672b664e80d260461a3f7fb1c14a45c614eb6124876ce2a7",
    "GPL-3.0": "969fd5d620157eced8b632e4ba7154859f195397976b89e7ee716615116fc70a",
    "LGPL-2.0": "1f1ace2d2c5e80547f3f0517299934f8d456c17a9a9939250e76087b010f5614",
    "LGPL-2.1": "6eacb2e57ceb0cc63a48b9b4e3181e4b691c27408dfd80dc12bafc4bffff46b5",
    "LGPL-3.0": "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be",
    "MPL-1.1": "3f0343dd4f3b064be36e0c6584737c9b7bb5c322721694563f9009e088ce96d1",
    "MPL-2.0": "6fedd8db6adb0e102fc0f69b9e1501d2edaf25940e34910831cab46f9f5d4e4d",
}
NOTICES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0."],
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under CC BY-NC 4.0."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
}
#: Licences that single lines name by a machine-readable tag.
TAGGED = ("0BSD", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC0-1.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT", "MIT-0", "MPL-2.0", "Unlicense", "Zlib")
#: Equivalent spellings, as found after lower-casing and before punctuation goes.
SPELLINGS = (("licence", "license"), ("sub-license", "sublicense"), ("non-infringement", "noninfringement"), ("merchantibility", "merchantability"), ("copyright owner", "copyright holder"))
_COPYRIGHT = r"(^|\n)[ \t]*(copyright|©|\(c\))[^\n]*[0-9]{4}[^\n]*"


def canonical(text: str) -> str:
    """The canonical form, in Python: for the known texts, and the reference for the columns below."""
    t = re.sub(_COPYRIGHT, r"\1", text.lower())
    for a, b in SPELLINGS:
        t = t.replace(a, b)
    return re.sub(r"[^\w]+", " ", re.sub(r"[^\x00-\x7f]", lambda m: m[0] if m[0].isalpha() else " ", t).replace("_", " ")).strip()


def canonical_sql(column: str, ours: bool = True) -> str:
    """The canonical form as SQL, of Spark (ours) or of DuckDB."""

    def sub(e, pattern, to):
        if ours:
            escaped = pattern.replace("\\", "\\\\")
            return f"regexp_replace({e}, '{escaped}', '{to}')"
        return f"regexp_replace({e}, '{pattern}', '{to}', 'g')"

    e = sub(f"lower({column})", _COPYRIGHT, "$1" if ours else "\\1")
    for a, b in SPELLINGS:
        e = f"replace({e}, '{a}', '{b}')"
    return f"trim({sub(e, r'[^\p{L}\p{N}]+', ' ')})"


def known_digests() -> list[tuple[str, str, str]]:
    """(kind, digest, licence) of the known texts and notices."""
    notices = list(NOTICES.items()) + [(name, [f"SPDX-License-Identifier: {name}"]) for name in TAGGED]
    made = [(kind, hashlib.sha256(canonical(t).encode()).hexdigest(), name) for kind, of in (("text", KNOWN.items()), ("notice", notices)) for name, texts in of for t in texts]
    return sorted(set(made) | {("text", digest, name) for name, digest in DIGESTS.items()})


def scan(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, text_sha256 (of the canonical form), license (of the whole text) and notices (licences named in single lines, sorted, joined by commas) of every row."""
    known = known_digests()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    notices = "map(" + ", ".join(f"'{d}', '{name}'" for kind, d, name in known if kind == "notice") + ")"
    lines = "filter(split(text, '\n', -1), x -> lower(x) like '%licen%')"
    named = f"array_sort(array_distinct(filter(transform({lines}, x -> try_element_at({notices}, sha2({canonical_sql('x')}, 256))), n -> n is not null)))"
    rows = rows.withColumn("c", F.expr(canonical_sql("text"))).select("doc_id", F.expr("if(c = '', null, sha2(c, 256))").alias("text_sha256"), F.expr(f"if(text is null, cast(array() as array<string>), {named})").alias("n"))
    texts = docs.sparkSession.createDataFrame([(d, name) for kind, d, name in known if kind == "text"], "text_sha256 string, license string")
    return rows.join(F.broadcast(texts), "text_sha256", "left").select("doc_id", "text_sha256", "license", F.expr("if(size(n) = 0, null, array_join(n, ','))").alias("notices"))


def op8_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op8_sql() -> str:
    values = ", ".join(f"('{k}', '{d}', '{n}')" for k, d, n in known_digests())
    return f"""WITH known(kind, digest, name) AS (VALUES {values}),
 whole AS (SELECT doc_id, {canonical_sql("text", False)} AS c FROM documents),
 lines AS (SELECT doc_id, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) x WHERE lower(line) LIKE '%licen%'),
 found AS (SELECT doc_id, string_agg(name, ',' ORDER BY name) AS notices FROM (SELECT DISTINCT doc_id, name FROM lines JOIN known ON kind = 'notice' AND digest = sha256({canonical_sql("line", False)})) y GROUP BY doc_id)
SELECT w.doc_id, CASE WHEN c <> '' THEN sha256(c) END AS text_sha256, k.name AS license, f.notices
FROM whole w LEFT JOIN (SELECT digest, name FROM known WHERE kind = 'text') k ON k.digest = sha256(c) LEFT JOIN found f ON f.doc_id = w.doc_id"""
