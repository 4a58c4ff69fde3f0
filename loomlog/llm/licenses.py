"""Licence scan: canonical texts are looked up by digest among known licences.

Canonical form: lower case; every run of characters other than letters and
digits is one space; equivalent spellings of whole words are unified; lines that state a
copyright are left out.  A document's whole canonical text is hash-joined to
the digests of known licences, and so is each of its lines, which finds notices
of one line.  Known licences are a table (license_id, text), so a user can
bring any list.  ``KNOWN``, the built-in one, has the whole texts of MIT, ISC,
BSD-2-Clause, BSD-3-Clause, 0BSD, Zlib and BSL-1.0, the file headers of
Apache-2.0 and MPL-2.0, and notices of one line; other whole texts are matched
only from a list that has them.

Defined results: null texts, and texts with nothing left, match nothing; the
same digest under two ids gives the smaller id; repeated rows keep their own
row each; an empty table of licences matches nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Equivalent spellings, as in public licence matching guidelines.
SPELLINGS = (
    ("licence", "license"), ("sub license", "sublicense"), ("non commercial", "noncommercial"),
    ("acknowledgement", "acknowledgment"), ("favour", "favor"),
    ("honour", "honor"), ("organisation", "organization"), ("authorisation", "authorization"),
    ("per cent", "percent"), ("copyright owner", "copyright holder"),
)
#: Canonical lines that only state a copyright.
COPYRIGHT = r"^(?:copyright|c) (?:c )?(?:[0-9]{4}|by |the )|^copyright c\b|^all rights reserved$"

# Public licence texts and notices.
_GRANT_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n"
_BSD_NAME = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
_BSD_TAIL = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_0BSD = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n" + _ISC.split("\n")[1]
_ZLIB = "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n3. This notice may not be removed or altered from any source distribution."
_BOOST = "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:\nThe copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
KNOWN = (
    ("MIT", "MIT License\n" + _GRANT_MIT),
    ("MIT", "The MIT License (MIT)\n" + _GRANT_MIT),
    ("MIT", _GRANT_MIT),
    ("ISC", "ISC License\n" + _ISC),
    ("ISC", _ISC),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_TAIL),
    ("BSD-2-Clause", "BSD 2-Clause License\n" + _BSD_HEAD + _BSD_TAIL),
    ("BSD-3-Clause", _BSD_HEAD + _BSD_NAME + _BSD_TAIL),
    ("BSD-3-Clause", "BSD 3-Clause License\n" + _BSD_HEAD + _BSD_NAME + _BSD_TAIL),
    ("0BSD", _0BSD),
    ("0BSD", "BSD Zero Clause License\n" + _0BSD),
    ("Zlib", _ZLIB),
    ("Zlib", "zlib License\n" + _ZLIB),
    ("BSL-1.0", _BOOST),
    ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003\n" + _BOOST),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\nhttp://www.apache.org/licenses/LICENSE-2.0\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "SPDX-License-Identifier: CC-BY-NC-4.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "SPDX-License-Identifier: CC0-1.0"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
)


def canonical_lines(text: Column) -> Column:
    """The canonical lines of a text, in order, without empty and copyright lines, before spellings are unified."""
    t = F.regexp_replace(F.lower(text.cast("string")), "[^\\p{L}\\p{N}\\n]+", " ")
    lines = F.transform(F.split(t, "\n"), lambda line: F.trim(line))
    return F.filter(lines, lambda line: (line != "") & ~(line.startswith("c") & line.rlike(COPYRIGHT)) & (line != "all rights reserved"))


def spelled(words: Column) -> Column:
    """Words with single spaces between them, in one spelling each; only whole words are replaced.

    Every word gets a space of its own on both sides, so that neighbours can both be replaced.
    """
    t = F.concat(F.lit(" "), F.replace(words, F.lit(" "), F.lit("  ")), F.lit(" "))
    for other, one in SPELLINGS:
        t = F.replace(t, F.lit(f" {other.replace(' ', '  ')} "), F.lit(f" {one.replace(' ', '  ')} "))
    return F.trim(F.replace(t, F.lit("  "), F.lit(" ")))


def digest(canonical: Column) -> Column:
    return F.when(canonical != "", F.sha2(canonical, 256))


def known_licenses(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(KNOWN), "license_id string, text string")


def known_digests(known: DataFrame) -> DataFrame:
    """(digest, license_id), one row a digest."""
    whole = known.select("license_id", digest(spelled(F.array_join(canonical_lines(F.col("text")), " "))).alias("digest"))
    return whole.filter("digest IS NOT NULL").groupBy("digest").agg(F.min("license_id").alias("license_id"))


def scan_licenses(docs: DataFrame, known: DataFrame | None = None, text: str = "text") -> DataFrame:
    """doc_id, text_sha256 (of the canonical text), text_license, n_license_lines, line_licenses (sorted, joined by commas).

    Line digests are joined as (row, digest) pairs of distinct lines; Spark
    broadcasts the known digests if they are small and shuffles otherwise.
    """
    known = known_digests(known_licenses(docs.sparkSession) if known is None else known)
    lines = docs.select("doc_id", F.monotonically_increasing_id().alias("__row"), canonical_lines(F.col(text)).alias("__lines"))
    lines = lines.select("doc_id", "__row", digest(spelled(F.array_join("__lines", " "))).alias("text_sha256"), F.transform("__lines", lambda x: F.sha2(spelled(x), 256)).alias("__lines"))
    exploded = lines.select("doc_id", "__row", "text_sha256", F.explode_outer("__lines").alias("digest"))
    hit = exploded.join(known.withColumnRenamed("license_id", "__line"), "digest", "left")
    rows = hit.groupBy("__row", "doc_id", "text_sha256").agg(F.count("__line").alias("n_license_lines"), F.array_join(F.array_sort(F.collect_set("__line")), ",").alias("line_licenses"))
    return rows.join(known.select(F.col("digest").alias("text_sha256"), F.col("license_id").alias("text_license")), "text_sha256", "left").select("doc_id", "text_sha256", "text_license", "n_license_lines", "line_licenses")
