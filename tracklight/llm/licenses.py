"""Licence scans by canonical digest lookup.

A text is brought to a canonical form (lower case, equivalent spellings, copyright lines and licences' titles out, everything but
letters, marks, digits and line ends to single spaces) and hashed whole; digests are joined with those of known licence texts. Each
line is looked up in the same way, and each paragraph (what blank lines part): all paragraphs of a known text in a row are that
text, wherever they stand, however their lines are wrapped. The known texts are a parameter, a list or a table of any size: a
document's digests meet them in one join, broadcast up to MOST_KNOWN entries, which is counted, and shuffled beyond that, where
adaptive execution splits lines that many documents have.

Null texts count as empty; texts without letters or digits match nothing, and known ones without are left out; very long texts
are looked up whole, by all of their lines and paragraphs; repeated rows give repeated results; an empty table gives no rows, and
without known texts nothing is found; extra columns are dropped. Licences come in alphabetical order, without repeats.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklight.llm.common import as_text

MOST_KNOWN = 10_000
#: Equivalent spellings, fixed values: the left form becomes the right one.
SPELLINGS = (
    ("licence", "license"), ("sub-license", "sublicense"), ("non-commercial", "noncommercial"), ("organisation", "organization"), ("authorised", "authorized"),
    ("merchantibility", "merchantability"), ("whilst", "while"), ("favour", "favor"), ("http://", "https://"), ("&", " and "), ("©", "(c)"),
)
#: Words of the terms that a wrapped line may start with, fixed values; KEPT takes the place of "copyright" there until claims are out.
WRAPPED_LINE = r"(?m)^([^\p{L}\p{N}\n]*)copyright +(notices?|holders?|owners?|laws?|interest|licenses?|statements?|and|or|in|to|of|treaty|permission)\b"
KEPT = "zz9copyright"
#: A line that starts with a claim: "copyright", "(c)" and a year, or "all rights reserved" as the notice itself, not as a word of the terms.
COPYRIGHT_LINE = r"(?m)^[^\p{L}\p{N}\n]*(copyright\b|\(c\) *([0-9]{4}|copyright)|all rights reserved)[^\n]*$"
#: A line that is the title of a licence and nothing else, with or without version and year. Names are fixed values.
TITLE_LINE = r"(?m)^[^\p{L}\p{N}\n]*(the +)?((new|simplified|revised|modified|[0-4]-clause|zero-clause) +)?(mit|isc|bsd|zlib|zlib/libpng|apache|mozilla public|boost software|gnu( lesser| affero)? general public|eclipse public)( +[0-4]-clause)?( +\"[a-z]+\")? +license( *\([^()\n]{1,30}\))?([ ,-]+version +[0-9.]+)?([ ,-]+[a-z0-9 ,]{0,20}[0-9]{4})?[^\p{L}\p{N}\n]*$"
#: What is no part of the canonical form.
OTHER = r"[^\p{L}\p{M}\p{N}\n]+"

#: Parts of two of the known texts, fixed values.
BSD_TERMS = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
BSD_DISCLAIMER = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
#: Known texts, fixed values: notices in common use, and short licences whole.
KNOWN = (
    ("BSD-2-Clause", f"{BSD_TERMS}\n\n{BSD_DISCLAIMER}"),
    ("BSD-3-Clause", f"{BSD_TERMS}\n\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\n{BSD_DISCLAIMER}"),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n\n3. This notice may not be removed or altered from any source distribution."),
    ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003\n\nPermission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:\n\nThe copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("Unlicense", "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.\n\nIn jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.\n\nFor more information, please refer to <https://unlicense.org>"),
    ("WTFPL", "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE\nVersion 2, December 2004\n\nEveryone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.\n\nDO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE\nTERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION\n\n0. You just DO WHAT THE FUCK YOU WANT TO."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\n    https://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
)


def canonical_lines(text: Column) -> Column:
    """The canonical form, with its line ends."""
    out = F.lower(text)
    for old, new in SPELLINGS:
        out = F.replace(out, F.lit(old), F.lit(new))
    out = F.regexp_replace(out, WRAPPED_LINE, f"$1{KEPT} $2")
    out = F.regexp_replace(F.regexp_replace(out, COPYRIGHT_LINE, ""), TITLE_LINE, "")
    out = F.replace(out, F.lit(KEPT), F.lit("copyright"))
    return F.regexp_replace(out, OTHER, " ")


def canonical_whole(lines: Column) -> Column:
    return F.trim(F.regexp_replace(lines, r"[ \n]+", " "))


def paragraphs(lines: Column) -> Column:
    """The paragraphs of a canonical form, in order, each in one line."""
    return F.filter(F.transform(F.split(lines, r"\n *\n"), canonical_whole), lambda x: x != "")


def _digest(text: Column) -> Column:
    return F.md5(text.cast("binary"))


def known_digests(known: DataFrame) -> DataFrame:
    """For the digest of each different known text licenses (in order), and for that of each paragraph (part) the places where it stands: the text, its number there and how many there are."""
    forms = known.select("license", canonical_lines(F.col("text")).alias("form")).withColumn("text", canonical_whole(F.col("form"))).where("text != ''")
    texts = forms.withColumn("digest", _digest(F.col("text"))).groupBy("digest").agg(F.array_sort(F.collect_set("license")).alias("licenses"), F.min_by("form", "form").alias("form"))
    parts = texts.select(F.col("digest").alias("whole"), "licenses", F.posexplode(paragraphs(F.col("form"))).alias("at", "part"), F.size(paragraphs(F.col("form"))).alias("of"))
    placed = parts.groupBy(_digest(F.col("part")).alias("digest")).agg(F.collect_list(F.struct("whole", "at", "of", "licenses")).alias("places"))
    none = F.lit(None)
    whole = texts.select("digest", F.lit(False).alias("part"), "licenses", none.cast(placed.schema["places"].dataType).alias("places"))
    return whole.unionByName(placed.select("digest", F.lit(True).alias("part"), none.cast("array<string>").alias("licenses"), "places"))


def scan(docs: DataFrame, known=KNOWN) -> DataFrame:
    """doc_id, digest (of the whole canonical text), license (of the whole text, or null; the first of several) and notices (of its lines and of its paragraphs in a row). known: pairs of licence and text, or a table of these columns."""
    spark = docs.sparkSession
    if not isinstance(known, DataFrame):
        known = spark.createDataFrame([(str(k), str(t)) for k, t in known], "license string, text string")
    table = known_digests(known)
    if known.count() <= MOST_KNOWN:
        table = F.broadcast(table)
    lines = F.array_distinct(F.filter(F.transform(F.split("form", "\n"), lambda x: F.trim(x)), lambda x: x != ""))
    form = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", canonical_lines(as_text(F.col("text"))).alias("form"))
    whole = form.select("row", "doc_id", _digest(canonical_whole(F.col("form"))).alias("whole"), lines.alias("lines"), paragraphs(F.col("form")).alias("parts"))
    key = lambda digest, kind, at: F.struct(digest.alias("digest"), (F.lit(kind) == 2).alias("part"), F.lit(kind).alias("kind"), at.alias("place"))
    keys = F.concat(F.array(key(F.col("whole"), 0, F.lit(0))), F.transform("lines", lambda x: key(_digest(x), 1, F.lit(0))), F.transform("parts", lambda x, k: key(_digest(x), 2, k)))
    # lines and paragraphs that are nobody's notice end here, so that about one row for each document is shuffled
    met = whole.select("row", "doc_id", "whole", F.explode(keys).alias("key")).select("row", "doc_id", "whole", "key.*").join(table, ["digest", "part"], "left")
    met = met.where("kind = 0 or licenses is not null or places is not null")
    hits = met.select("row", "doc_id", "whole", "kind", "place", "licenses", F.explode_outer("places").alias("known"))
    # paragraphs in a row of one text have one start
    runs = hits.groupBy("row", "doc_id", "whole", "kind", F.col("known.whole").alias("text"), (F.col("place") - F.col("known.at")).alias("start")).agg(
        F.first("known.of").alias("of"), F.count_distinct("known.at").alias("n"), F.first("known.licenses").alias("own"), F.collect_set("licenses").alias("sets")
    )
    found = F.when((F.col("kind") == 2) & (F.col("n") == F.col("of")), F.col("own")).when(F.col("kind") == 1, F.flatten("sets"))
    out = runs.groupBy("row", "doc_id", "whole").agg(F.first(F.when(F.col("kind") == 0, F.get(F.flatten("sets"), F.lit(0))), ignorenulls=True).alias("license"), F.collect_set(found).alias("sets"))
    return out.select("doc_id", F.col("whole").alias("digest"), "license", F.array_sort(F.array_distinct(F.flatten("sets"))).alias("notices"))
