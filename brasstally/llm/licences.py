"""Licence scans by canonical digests, as DataFrame expressions only.

A text is lower-cased, its equivalent spellings are made one and its punctuation becomes single spaces; lines
that state a copyright or only reserve all rights go. The SHA-256 of what is left of the whole text is joined with the digests of
known licences. Single lines are looked up among known notices on the way, so the text is read and made canonical once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Texts of public licences.
_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
)
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
_BSD_1 = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
_BSD_2 = "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
_BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_TAIL = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF '
    "MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS "
    "INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE "
    "OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_ISC_TAIL = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. '
    "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
    "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_PERMISSION = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_NOTICE_KEPT = ", provided that the above copyright notice and this permission notice appear in all copies"
_MIT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without '
    "restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom "
    "the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
    + _WARRANTY
    + "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
    "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ZLIB = (
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
    "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
    "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the "
    "product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. "
    "3. This notice may not be removed or altered from any source distribution."
)
_UNLICENSE = (
    "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a "
    "compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright "
    "interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of "
    "relinquishment in perpetuity of all present and future rights to this software under copyright law. "
    + _WARRANTY
    + "IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR "
    "OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to <https://unlicense.org>"
)
_APACHE_NOTICE = (
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at '
    "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
    "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
)
#: (licence, text) for short whole texts; each also counts with its title before it.
LICENCES = [
    ("MIT", _MIT), ("MIT", "MIT License " + _MIT), ("MIT", "The MIT License (MIT) " + _MIT), ("MIT", "The MIT License " + _MIT),
    ("ISC", _PERMISSION + _NOTICE_KEPT + ". " + _ISC_TAIL), ("ISC", "ISC License " + _PERMISSION + _NOTICE_KEPT + ". " + _ISC_TAIL),
    ("0BSD", _PERMISSION + ". " + _ISC_TAIL), ("0BSD", "Zero-Clause BSD " + _PERMISSION + ". " + _ISC_TAIL),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_1 + _BSD_2 + _BSD_TAIL), ("BSD-2-Clause", "BSD 2-Clause License " + _BSD_HEAD + _BSD_1 + _BSD_2 + _BSD_TAIL),
    ("BSD-3-Clause", _BSD_HEAD + _BSD_1 + _BSD_2 + _BSD_3 + _BSD_TAIL), ("BSD-3-Clause", "BSD 3-Clause License " + _BSD_HEAD + _BSD_1 + _BSD_2 + _BSD_3 + _BSD_TAIL),
    ("Zlib", _ZLIB), ("Zlib", "zlib License " + _ZLIB), ("Unlicense", _UNLICENSE), ("Apache-2.0", _APACHE_NOTICE),
]
#: (licence, notice) for single lines.
NOTICES = [
    ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT License."), ("MIT", "This project is licensed under the MIT License."), ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."), ("Apache-2.0", "Released under the Apache License, Version 2.0."), ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."), ("GPL-3.0", "Licensed under the GNU General Public License, version 3."), ("GPL-3.0", "Released under the GNU General Public License, version 3."), ("GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("CC-BY-NC-4.0", "This work is licensed under CC BY-NC 4.0."), ("CC-BY-4.0", "Licensed under CC BY 4.0."), ("CC-BY-4.0", "This work is licensed under CC BY 4.0."), ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."), ("CC-BY-SA-4.0", "This work is licensed under CC BY-SA 4.0."), ("CC0-1.0", "Released under CC0 1.0."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"), ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."), ("Proprietary", "All rights reserved."),
]
# Spellings that count as the same word.
SPELLINGS = {"licence": "license", "licences": "licenses", "licenced": "licensed", "sublicence": "sublicense", "sub license": "sublicense", "non infringement": "noninfringement", "acknowledgement": "acknowledgment", "merchantibility": "merchantability", "http": "https", "copyright owner": "copyright holder", "analyse": "analyze", "favour": "favor", "per cent": "percent"}
# Digests of the canonical texts of long public licences, with and without what follows the end of their terms.
DIGESTS = [
    ("Apache-2.0", "4d82b1bff1ec74deb3a29bbe890a43fcd5d6d11ae4b24b20d2c0ef74a1b12809"),
    ("Apache-2.0", "4db164cc277b72e3d03f4161513c53b32de1cf3a402162a025e00d038383a74f"),
    ("Apache-2.0", "b93faad605f4e5d56d92cb01789c993887913c893e441b2305b4f880a9cead93"),
    ("Artistic-1.0-Perl", "e963bc30f4d3c45f45030c34409ee37315564625649c1394e32bb5ddd99e01b2"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2", "5379e6f33e826ba185b23fd11a414555c2161fda481478babd1e73a3ae098a71"),
    ("GFDL-1.3", "93d6108daecdddc5f284cf8f2512fb0d72f6e9ee12381feb9704ba194b00c3e6"),
    ("GPL-1.0", "6375a768fd262bf5281905a9585411d2d0fb4ea15cb08cfcba49f73fedb82abc"),
    ("GPL-1.0", "89f75ffda938e788be38679f9f83e317c2a03398fccf03ee60505d44d1bf9f70"),
    ("GPL-1.0", "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224"),
    ("GPL-2.0", "6d332dc4c3c5293a73c6c9da402f9bbc970b3bb1eb472f577e00580573469808"),
    ("GPL-2.0", "e1270b653c300290e7c039142bccb8776f9b5d14e8a05bc4e87dc7d1614a3b34"),
    ("GPL-2.0", "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821"),
    ("GPL-3.0", "092a7f3b82e6c22949b46388bca99e725b6e756f1c2b1e3f575447fbd44b6191"),
    ("GPL-3.0", "a8cd54d6683aa630f0b8d05d56184ad91dc486756da2df61c94d3e4e8d5ecb68"),
    ("GPL-3.0", "ac6b52d57c0104e687039148f7b8e370e04c9bb5705bb786f8ef814eb65e8636"),
    ("LGPL-2.0", "430627da7218a92ab4a6d75d5140cdb70ee750be7a53f913299b37e0d1b0eea2"),
    ("LGPL-2.0", "504542bce5421b0f5a7e63ddb55443ccb300b27a65ba6bfc1370fed16a3af260"),
    ("LGPL-2.0", "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908"),
    ("LGPL-2.1", "48d2010e70a815a564f914b0c7c1e80d7a6843793348fed3684c957112fe0aa4"),
    ("LGPL-2.1", "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891"),
    ("LGPL-2.1", "bf2f0c6bf1c47b3b1e3cbedeefecddd1e7db21d1919858d45c2f918efaf426df"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "18285bb1ad96820bff9c9d0ad8afd287be81e1fb278bd99ca194d3a69d622294"),
    ("MPL-1.1", "26ba73e836ecb04fe87d5eca80ca27cff1afa2d7683455be1517bd23b8d27986"),
    ("MPL-2.0", "075fcdf87448c49dbad8c5f7963f0eb6907a3d8eae1b431ba2988508499ec0de"),
    ("MPL-2.0", "9eab7902f21bef0326dee4ed0cae1402c781cbf1f8e3dbeed6fbe176d641bb13"),
]
# A line that starts with a mark, a copyright with a mark or a year, or a year in brackets' place ...
_MARKED = r"(?i)^[^\p{L}\p{N}©(]*((some )?(portions|parts)( of this (software|file|work))?( are)? )?(©|copyright[ \t:,]*(\(c\)|©|[0-9]{4})|copr\.? *[0-9]{4}|\(c\) *[0-9]{4})"
# ... or Copyright and a name, which isn't the beginning of a sentence about copyrights ...
_NAMED = r"^[^\p{L}\p{N}]*((Some )?[Pp](ortions|arts) (of this (software|file|work) )?(are )?)?Copyright:? (by )?([Tt]he )?\p{Lu}"
_NOT_NAMED = r"^[^\p{L}\p{N}]*Copyright (Notice|License|Licence|Law|Holder|Owner|Act|Statement|And|Policy|Information|Treaty|Permission)"
# ... or a copyright whose line ends with a year, or nothing but reserved rights.
_DATED = r"(?i)^[^\p{L}\p{N}]*copyright .*(19|20)[0-9]{2}[^\p{L}\p{N}]*(all rights reserved[^\p{L}\p{N}]*)?$"
_RESERVED = r"(?i)^[^\p{L}\p{N}]*all rights reserved[^\p{L}\p{N}]*$"


def _stated(line: Column) -> Column:
    """Whether a raw line states a copyright or only reserves all rights."""
    return line.rlike(_MARKED) | (line.rlike(_NAMED) & ~line.rlike(_NOT_NAMED)) | line.rlike(_DATED) | line.rlike(_RESERVED)


def canonical_lines(text: Column) -> Column:
    """All lines as lower-case words with single spaces. Two spaces between words for a while let neighbours be replaced alike."""
    plain = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\n]+", "  ")
    spaced = F.concat(F.lit("  "), F.replace(plain, F.lit("\n"), F.lit("  \n  ")), F.lit("  "))
    same = reduce(lambda c, kv: F.replace(c, F.lit(f" {kv[0].replace(' ', '  ')} "), F.lit(f" {kv[1].replace(' ', '  ')} ")), SPELLINGS.items(), spaced)
    return F.transform(F.split(same, "\n"), lambda x: F.trim(F.replace(x, F.lit("  "), F.lit(" "))))


def canonical_text(text: Column, lines: Column) -> Column:
    """The canonical text by its canonical lines; raw lines are looked at only where a statement may be among them."""
    low = F.lower(text)
    doubtful = reduce(lambda a, b: a | b, (low.contains(x) for x in ("copyright", "©", "(c)", "copr", "all rights reserved")))
    raw = F.split(text, "\n")
    left = F.when(doubtful, F.filter(lines, lambda x, i: (x != "") & ~_stated(F.get(raw, i)))).otherwise(F.filter(lines, lambda x: x != ""))
    return F.array_join(left, " ")


def _canonical(spark: SparkSession, texts: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """(licence, canonical text) of a fixed list of texts of one line."""
    rows = spark.range(1).select(F.inline(F.array(*(F.struct(F.lit(name).alias("licence"), F.lit(text).alias("t")) for name, text in texts))))
    return sorted({(r["licence"], r["c"]) for r in rows.select("licence", F.element_at(canonical_lines(F.col("t")), 1).alias("c")).collect()})


def known(spark: SparkSession) -> DataFrame:
    """licence and digest of all known whole texts, a fixed list so small that every task gets it."""
    short = spark.range(1).select(F.inline(F.array(*(F.struct(F.lit(n).alias("licence"), F.lit(t).alias("c")) for n, t in _canonical(spark, LICENCES)))))
    long = spark.range(1).select(F.inline(F.array(*(F.struct(F.lit(n).alias("licence"), F.lit(d).alias("digest")) for n, d in DIGESTS))))
    return F.broadcast(short.select("licence", F.sha2("c", 256).alias("digest")).unionByName(long).distinct())


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, digest (of the canonical text), licence (of the whole text, or null) and notices of every document.

    notices names the licences of the lines that are known notices, sorted and joined by a comma, empty if there are none. A null
    text counts as an empty one. Every row stays and is judged by itself, repeated ones and those without a doc_id too. Other columns
    are ignored; an empty table gives an empty result. A copyright statement that shares its line with the licence's words isn't taken from it.
    """
    spark = docs.sparkSession
    notices = _canonical(spark, NOTICES)
    names = F.create_map(*(F.lit(x) for n, c in notices for x in (c, n)))
    longest = max(len(c) for _, c in notices)
    lines = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("lines", canonical_lines(F.col("text")))
    short = F.filter("lines", lambda x: F.length(x).between(1, longest) & F.map_contains_key(names, x))
    found = lines.select(
        "doc_id", F.sha2(canonical_text(F.col("text"), F.col("lines")), 256).alias("digest"),
        F.array_join(F.sort_array(F.array_distinct(F.transform(short, lambda x: F.element_at(names, x)))), ",").alias("notices"),
    )
    return found.join(known(spark), "digest", "left").select("doc_id", "digest", "licence", "notices")


# The SQL's own tables, digests of whole texts and canonical notices.
_SQL_LICENCES = [
    ("0BSD", "25a274d52b3014d9bd64e0f3362fd279ac1655f163d5c518f6b9f6c43354802c"),
    ("0BSD", "53695ed162cb0132fe0563719addeac105c8cad72350fae9183e2c74a7c0dbbe"),
    ("Apache-2.0", "4d82b1bff1ec74deb3a29bbe890a43fcd5d6d11ae4b24b20d2c0ef74a1b12809"),
    ("Apache-2.0", "4db164cc277b72e3d03f4161513c53b32de1cf3a402162a025e00d038383a74f"),
    ("Apache-2.0", "b93faad605f4e5d56d92cb01789c993887913c893e441b2305b4f880a9cead93"),
    ("Apache-2.0", "c40235f98e8998f2e4f5fc5131b16fb3c6c5f8ce252d3e6e08daf233725c2073"),
    ("Artistic-1.0-Perl", "e963bc30f4d3c45f45030c34409ee37315564625649c1394e32bb5ddd99e01b2"),
    ("BSD-2-Clause", "447686a56472ea2e9713ca89034ee666e6646bd1a33eba38690cb875708663e2"),
    ("BSD-2-Clause", "a56fee4b2f66331ed54da4950ef9c9391453fd1490b4d8ea202bc29683bcbd30"),
    ("BSD-3-Clause", "9b83d3dee0616d07b82a272dd9bf5134a9f402b750f5ee6188458073b0a32ff2"),
    ("BSD-3-Clause", "cc65957a28f15bbcef5b0c23770aae3bd8462cb25904250f77a812ab3b2efe15"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2", "5379e6f33e826ba185b23fd11a414555c2161fda481478babd1e73a3ae098a71"),
    ("GFDL-1.3", "93d6108daecdddc5f284cf8f2512fb0d72f6e9ee12381feb9704ba194b00c3e6"),
    ("GPL-1.0", "6375a768fd262bf5281905a9585411d2d0fb4ea15cb08cfcba49f73fedb82abc"),
    ("GPL-1.0", "89f75ffda938e788be38679f9f83e317c2a03398fccf03ee60505d44d1bf9f70"),
    ("GPL-1.0", "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224"),
    ("GPL-2.0", "6d332dc4c3c5293a73c6c9da402f9bbc970b3bb1eb472f577e00580573469808"),
    ("GPL-2.0", "e1270b653c300290e7c039142bccb8776f9b5d14e8a05bc4e87dc7d1614a3b34"),
    ("GPL-2.0", "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821"),
    ("GPL-3.0", "092a7f3b82e6c22949b46388bca99e725b6e756f1c2b1e3f575447fbd44b6191"),
    ("GPL-3.0", "a8cd54d6683aa630f0b8d05d56184ad91dc486756da2df61c94d3e4e8d5ecb68"),
    ("GPL-3.0", "ac6b52d57c0104e687039148f7b8e370e04c9bb5705bb786f8ef814eb65e8636"),
    ("ISC", "217da0747cec63a2e734185db11cbaa819bcd9e5b83cd12f812128fffe66e26a"),
    ("ISC", "f172f90a892d869d5d840d5f4363218a9b21bdb1bd3925ba9c752d1660134fee"),
    ("LGPL-2.0", "430627da7218a92ab4a6d75d5140cdb70ee750be7a53f913299b37e0d1b0eea2"),
    ("LGPL-2.0", "504542bce5421b0f5a7e63ddb55443ccb300b27a65ba6bfc1370fed16a3af260"),
    ("LGPL-2.0", "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908"),
    ("LGPL-2.1", "48d2010e70a815a564f914b0c7c1e80d7a6843793348fed3684c957112fe0aa4"),
    ("LGPL-2.1", "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891"),
    ("LGPL-2.1", "bf2f0c6bf1c47b3b1e3cbedeefecddd1e7db21d1919858d45c2f918efaf426df"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MIT", "0cf21bdfd1964a97a8615e128534845826afbc887edc95aa5c925cbf64386b5c"),
    ("MIT", "35a446201226de6b27cfb7106d0f6c697f63bfeac2913dcf89024911e66ef164"),
    ("MIT", "6ad3654379e72bbdf8478d5c90fb1e2525aba033fbe675e0ef2248aac67c0f6f"),
    ("MIT", "6c833965e9ca4cf8095655005226f24fe8bf7b1605dbe513204837a7371fa127"),
    ("MPL-1.1", "18285bb1ad96820bff9c9d0ad8afd287be81e1fb278bd99ca194d3a69d622294"),
    ("MPL-1.1", "26ba73e836ecb04fe87d5eca80ca27cff1afa2d7683455be1517bd23b8d27986"),
    ("MPL-2.0", "075fcdf87448c49dbad8c5f7963f0eb6907a3d8eae1b431ba2988508499ec0de"),
    ("MPL-2.0", "9eab7902f21bef0326dee4ed0cae1402c781cbf1f8e3dbeed6fbe176d641bb13"),
    ("Unlicense", "fd1b07be5f4f94926b6ea4df3943b05ab90c1a1f3b1a3d574ae7ab58bca58fff"),
    ("Zlib", "1b8c5cd52eceb19ab0bc3cb40be110b1c0e7fa2671a3fe5866e59dd1502e69c7"),
    ("Zlib", "99618428d879198d4ae824db7ad07a9d0f9214f15429de52839cbe667713f21a"),
]
_SQL_NOTICES = [
    ("Apache-2.0", "licensed under the apache license version 2 0"),
    ("Apache-2.0", "released under the apache license version 2 0"),
    ("Apache-2.0", "spdx license identifier apache 2 0"),
    ("BSD-3-Clause", "licensed under the bsd 3 clause license"),
    ("BSD-3-Clause", "spdx license identifier bsd 3 clause"),
    ("CC-BY-4.0", "licensed under cc by 4 0"),
    ("CC-BY-4.0", "this work is licensed under cc by 4 0"),
    ("CC-BY-NC-4.0", "licensed under cc by nc 4 0"),
    ("CC-BY-NC-4.0", "this work is licensed under cc by nc 4 0"),
    ("CC-BY-SA-4.0", "licensed under cc by sa 4 0"),
    ("CC-BY-SA-4.0", "this work is licensed under cc by sa 4 0"),
    ("CC0-1.0", "released under cc0 1 0"),
    ("GPL-3.0", "licensed under the gnu general public license version 3"),
    ("GPL-3.0", "released under the gnu general public license version 3"),
    ("GPL-3.0", "this work is licensed under the gnu general public license version 3"),
    ("GPL-3.0-only", "spdx license identifier gpl 3 0 only"),
    ("MIT", "licensed under the mit license"),
    ("MIT", "released under the mit license"),
    ("MIT", "spdx license identifier mit"),
    ("MIT", "this project is licensed under the mit license"),
    ("Proprietary", "all rights reserved"),
]


def _oracle() -> str:
    canonical = r"'  ' || replace(regexp_replace(lower(t), '[^\p{L}\p{N}\n]+', '  ', 'g'), chr(10), '  ' || chr(10) || '  ') || '  '"
    for a, b in SPELLINGS.items():
        canonical = f"replace({canonical}, ' {a.replace(' ', '  ')} ', ' {b.replace(' ', '  ')} ')"
    stated = f"regexp_matches(raw[i], '{_MARKED}') OR (regexp_matches(raw[i], '{_NAMED}') AND NOT regexp_matches(raw[i], '{_NOT_NAMED}')) OR regexp_matches(raw[i], '{_DATED}') OR regexp_matches(raw[i], '{_RESERVED}')"
    rows = lambda pairs: ", ".join(f"('{n}', '{t}')" for n, t in pairs)
    names = f"MAP {{{', '.join(f"'{t}': '{n}'" for n, t in _SQL_NOTICES)}}}"
    return f"""
WITH texts AS (
  SELECT doc_id, coalesce(text, '') AS t FROM documents
), cut AS (
  SELECT doc_id, string_split(t, chr(10)) AS raw, list_transform(string_split({canonical}, chr(10)), lambda x: trim(replace(x, '  ', ' '))) AS lines FROM texts
), judged AS (
  SELECT doc_id, sha256(array_to_string(list_transform(list_filter(range(1, len(lines) + 1), lambda i: lines[i] <> '' AND NOT ({stated})), lambda i: lines[i]), ' ')) AS digest,
    array_to_string(list_sort(list_distinct(list_filter(list_transform(lines, lambda x: {names}[x]), lambda x: x IS NOT NULL))), ',') AS notices FROM cut
), known AS (SELECT * FROM (VALUES {rows(_SQL_LICENCES)}) v(licence, digest))
SELECT doc_id, digest, licence, notices FROM judged LEFT JOIN known USING (digest)
"""


ORACLE = _oracle()
