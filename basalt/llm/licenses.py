"""Licence scan by canonical digests.

A text is normalised (case, copyright lines, punctuation, white space and equivalent spellings) and
its SHA-256 is looked up by a hash join in a table of digests of known licence texts. Whole texts
are compared, so a licence inside a longer text is no match.

The known table is made here from the licence texts; its size is fixed (one row per text), which is
what allows its broadcast. Further texts can be given by the caller.

Defined results: null text has a null digest and no licence; a text without a letter or digit has
the digest of the empty text and no licence; repeated rows each get their own row.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basalt.llm import scratch

#: Equivalent spellings: public matching guidelines for licence texts treat these as the same word.
EQUIVALENT = {
    "acknowledgement": "acknowledgment", "analogue": "analog", "analyse": "analyze", "artefact": "artifact",
    "authorisation": "authorization", "authorised": "authorized", "calibre": "caliber", "cancelled": "canceled",
    "catalogue": "catalog", "centre": "center", "emphasise": "emphasize", "favour": "favor", "favourite": "favorite",
    "fulfil": "fulfill", "fulfilment": "fulfillment", "initialise": "initialize", "judgement": "judgment",
    "labelling": "labeling", "labour": "labor", "licence": "license", "licences": "licenses", "maximise": "maximize",
    "modelled": "modeled", "modelling": "modeling", "offence": "offense", "optimise": "optimize",
    "organisation": "organization", "organise": "organize", "owner": "holder", "owners": "holders",
    "practise": "practice", "programme": "program", "realise": "realize", "recognise": "recognize",
    "signalling": "signaling", "utilisation": "utilization", "whilst": "while", "wilful": "willful",
    "https": "http", "merchantibility": "merchantability",
}

#: Licence texts (fixed values).
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC_GRANT = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"""
ISC_NOTICE = """, provided that the above copyright notice and this permission notice appear in all copies."""
ISC_DISCLAIMER = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
BSD_THIRD = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
BSD_TAIL = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""
APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""

BOOST = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org>"""
WTFPL = """DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE
Version 2, December 2004

Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.

DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE
TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION

0. You just DO WHAT THE FUCK YOU WANT TO."""
MPL_NOTICE = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""
EPL_NOTICE = """This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/

SPDX-License-Identifier: EPL-2.0"""
CC_NOTICE = "This work is licensed under a Creative Commons {} License."


def gnu_notice(what: str, name: str, version: str, later: bool) -> str:
    """The notice that these licences ask to be put at the top of a file."""
    either = f"either version {version} of the License, or (at your option) any later version." if later else f"version {version} of the License."
    return f"""This {what} is free software{":" if version[0] == "3" else ";"} you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, {either}

This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details.

You should have received a copy of the GNU {name} along with this {what}. If not, see <https://www.gnu.org/licenses/>."""


#: Digests of the full texts of the long licences, as published, once normalised (fixed values;
#: ``folder_digests`` makes such a table out of a folder of licence texts).
FULL_TEXTS = {
    "Apache-2.0": "ebc600199db9838b4fc2d5288a12598c2702142177a89b3443f5cc87b137d94b",
    "Artistic-1.0-Perl": "f7fec2048e2502b8b653a12ac095bcb0601f72bbd1d535b2e8adf8e097d2f915",
    "CC0-1.0": "de4b88a2c819a4661af54f735069ed878216da8b4992b919b84afa18cfc0e54c",
    "GFDL-1.2": "37db86be8f16e9b8dfb0d63e1698ad2e07d54f312494c1cb2dbdb4fa37487f0f",
    "GFDL-1.3": "7befa86e5ee53162018d597eee81db6c727f3e64fab4641af93e19deab1807b4",
    "GPL-1.0": "9e12a40a9b22c45d116f19e1746b08ea0b853519de3e03ceb780f2a36d5f388c",
    "GPL-2.0": "b866f5427b78991db8012466b32f51c907f5e974fde5129a47372d0d0552e3a1",
    "GPL-3.0": "59a779feaae4de539260be3c8adb19c287a771586d211e12d93932777da37349",
    "LGPL-2.0": "96685b4d8003c3671feddcde58622afa814a3ac15dcc419f38b388aff5e16d1d",
    "LGPL-2.1": "22bd2802b7b313faf9750f494c8f07c9eaa0e00ba5b9f7a300e8fa36cfd1319e",
    "LGPL-3.0": "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be",
    "MPL-1.1": "fcb579371133afd771fed87cd5d8c6dc5648746c9945d4adf08ec5c79aba5c61",
    "MPL-2.0": "95f6a0d094cf3da6a140310541c7b576789031b600469b70877b34f97918e4c9",
}

KNOWN = {
    "MIT": [MIT, "MIT License\n\n" + MIT, "The MIT License (MIT)\n\n" + MIT, "Released under the MIT License."],
    "ISC": [ISC_GRANT + ISC_NOTICE + "\n\n" + ISC_DISCLAIMER, "ISC License\n\n" + ISC_GRANT + ISC_NOTICE + "\n\n" + ISC_DISCLAIMER],
    "0BSD": [ISC_GRANT + ".\n\n" + ISC_DISCLAIMER, "BSD Zero Clause License\n\n" + ISC_GRANT + ".\n\n" + ISC_DISCLAIMER],
    "BSD-2-Clause": [BSD_HEAD + BSD_TAIL, "BSD 2-Clause License\n\n" + BSD_HEAD + BSD_TAIL],
    "BSD-3-Clause": [BSD_HEAD + BSD_THIRD + BSD_TAIL, "BSD 3-Clause License\n\n" + BSD_HEAD + BSD_THIRD + BSD_TAIL],
    "Zlib": [ZLIB, "zlib License\n\n" + ZLIB],
    "Apache-2.0": [APACHE_NOTICE, "Licensed under the Apache License, Version 2.0."],
    "BSL-1.0": [BOOST, "Boost Software License - Version 1.0 - August 17th, 2003\n\n" + BOOST],
    "Unlicense": [UNLICENSE],
    "WTFPL": [WTFPL],
    "GPL-2.0": [gnu_notice("program", "General Public License", "2", True), gnu_notice("program", "General Public License", "2", False)],
    "GPL-3.0": [gnu_notice("program", "General Public License", "3", True), gnu_notice("program", "General Public License", "3", False), "This work is licensed under the GNU General Public License, version 3."],
    "LGPL-2.1": [gnu_notice("library", "Lesser General Public License", "2.1", True)],
    "LGPL-3.0": [gnu_notice("program", "Lesser General Public License", "3", True), gnu_notice("library", "Lesser General Public License", "3", True)],
    "AGPL-3.0": [gnu_notice("program", "Affero General Public License", "3", True)],
    "MPL-2.0": [MPL_NOTICE],
    "EPL-2.0": [EPL_NOTICE],
    "CC-BY-4.0": [CC_NOTICE.format("Attribution 4.0 International")],
    "CC-BY-SA-4.0": [CC_NOTICE.format("Attribution-ShareAlike 4.0 International")],
    "CC-BY-NC-4.0": [CC_NOTICE.format("Attribution-NonCommercial 4.0 International"), "Licensed under CC BY-NC 4.0."],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
}

_COPYRIGHT = re.compile(r"^[\W_]*(?:copyright\b|©|\(c\)|all rights reserved\b).*$", re.M)
_WORD = re.compile(r"[^\W_]+")


def normalise(text: str) -> str:
    """Canonical form: lower-case words in common spelling, copyright lines and punctuation gone."""
    low = text.lower()
    if "copyright" in low or "©" in low or "(c)" in low or "all rights" in low:
        low = _COPYRIGHT.sub("", low)
    words = _WORD.findall(low)
    swap = EQUIVALENT.keys() & set(words)
    if swap:
        words = [EQUIVALENT.get(w, w) for w in words]
    return " ".join(words)


def digest(text: str) -> str:
    return hashlib.sha256(normalise(text).encode()).hexdigest()


def known_digests(known: dict[str, list[str]] = KNOWN) -> dict[str, str]:
    """Digest to licence id, the first id winning where two texts are equal once normalised."""
    out: dict[str, str] = {}
    for name, texts in known.items():
        for t in texts:
            out.setdefault(digest(t), name)
    if known is KNOWN:
        for name, d in FULL_TEXTS.items():
            out.setdefault(d, name)
    return out


def folder_digests(path: str) -> dict[str, str]:
    """File name to digest for a folder of licence texts."""
    out = {}
    for name in sorted(os.listdir(path)):
        full = os.path.join(path, name)
        if os.path.isfile(full) and not os.path.islink(full):
            with open(full, encoding="utf-8", errors="replace") as f:
                out[name] = digest(f.read())
    return out


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        d = [None if t is None else digest(t) for t in b.column(b.num_columns - 1).to_pylist()]
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(d, pa.string())], [*b.schema.names[:-1], "digest"])


def scan_licenses(docs: DataFrame, *, text_col: str = "text", known: dict[str, list[str]] = KNOWN) -> DataFrame:
    """(row, digest, license): ``row`` has the other columns of each document."""
    spark = docs.sparkSession
    scratch.ship(spark)
    rest = [c for c in docs.columns if c != text_col]
    src = docs.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row") if rest else F.struct(F.lit(None).cast("long").alias("none")).alias("row"), F.col(text_col).alias("text"))
    row = src.schema["row"].dataType.simpleString()
    d = src.mapInArrow(_digests, f"row {row}, digest string")
    table = spark.createDataFrame(pa.table({"digest": list(known_digests(known)), "license": list(known_digests(known).values())}))
    return d.join(F.broadcast(table), "digest", "left").select("row", "digest", "license")


def op3_license_digest(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scan_licenses(docs).select("row.doc_id", "digest", "license")


def oracle() -> str:
    swaps = ", ".join(f"'{a}': '{b}'" for a, b in EQUIVALENT.items())
    rows = ", ".join(f"('{d}', '{n}')" for d, n in known_digests().items())
    return rf"""
WITH low AS (SELECT doc_id, regexp_replace(lower(text), '(?m)^[^\pL\pN]*(copyright\b|©|\(c\)|all rights reserved\b).*$', '', 'g') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[\pL\pN]+') AS words FROM low),
d AS (SELECT doc_id, sha256(array_to_string(list_transform(words, lambda x: coalesce(MAP {{{swaps}}}[x], x)), ' ')) AS digest FROM w)
SELECT d.doc_id, d.digest, k.license FROM d LEFT JOIN (VALUES {rows}) AS k(digest, license) ON d.digest = k.digest
"""
