"""Licence scans by canonical digest, in DataFrame functions only.

A text's canonical form is lower case without copyright lines, with one spelling for words that licences spell in two
ways, and with every run of other characters than letters and digits as one space.  Its SHA-256 joins the digests of
known licences as a whole; so a text is a licence exactly when nothing but case, punctuation, layout, spelling or copyright lines
differs.  The same digest taken of single lines finds notices.

The known digests are package data (licence_digests.csv), made by `catalogue` from the licence texts beside it, from common
notices and from an SPDX line for every SPDX id.  The README lists the licences that are known as a whole; of others only
notices are.  An id that differs from another in punctuation only ("+") has the same digest.  Spark's size check decides on its broadcast, and without one
the join shuffles digests only, never texts.  A digest that many rows share is the streamed side of that join.

Defined cases: null text: null digest, no licence.  A text that is empty in canonical form matches nothing.  Two known texts of
one digest give the least licence id.  Repeated rows and null ids stay; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import csv
from itertools import chain
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A line that names a holder: "Copyright" with a sign, year, "by" or a placeholder; or the sign with a year.
COPYRIGHT_LINE = r"(^|\n)[^a-z0-9\n]*(?:copyright[ \t]*(?:\(c\)|©|[0-9]{4}|by |<|\[)|(?:\(c\)|©)[ \t]*[0-9]{4}|all rights reserved\.?[ \t]*(?![^\n]))[^\n]*"
OTHER = r"[^\p{L}\p{N}]+"
# fixed values: words with two spellings in licences, and the one kept
SPELLINGS = (
    ("licence", "license"),
    ("sub license", "sublicense"),
    ("acknowledgement", "acknowledgment"),
    ("organisation", "organization"),
    ("authoris", "authoriz"),
    ("non commercial", "noncommercial"),
    ("per cent", "percent"),
    ("fulfil ", "fulfill "),
    ("favour", "favor"),
    ("judgement", "judgment"),
    ("whilst", "while"),
    ("wilful", "willful"),
    ("copyright owner", "copyright holder"),
    ("https ", "http "),
)
# fixed values: short texts and notices of public licences
KNOWN = (
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("ISC", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("MIT", "Released under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
)


def canonical(text: Column) -> Column:
    out = F.regexp_replace(F.lower(text), COPYRIGHT_LINE, "$1")
    out = F.concat(F.lit(" "), F.regexp_replace(out, OTHER, " "), F.lit(" "))
    for a, b in SPELLINGS:
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(out, " +", " "))


TEXTS, DIGESTS = Path(__file__).parent / "licence_texts", Path(__file__).parent / "licence_digests.csv"
# fixed values: titles that may stand above a text that has none (or be left out), and names in notices
TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)"),
    "ISC": ("ISC License", "The ISC License"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The BSD 2-Clause License", 'BSD 2-Clause "Simplified" License', "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "The BSD 3-Clause License", 'BSD 3-Clause "New" or "Revised" License', "New BSD License", "Modified BSD License"),
    "Zlib": ("zlib License", "The zlib License", "zlib/libpng License"),
    "Unlicense": ("The Unlicense", "Unlicense"),
}
NAMES = {
    "MIT": ("MIT License", "MIT"),
    "ISC": ("ISC License",),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache-2.0 License", "Apache 2.0", 'Apache License, Version 2.0 (the "License")'),
    "BSD-2-Clause": ("BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License", "BSD-2-Clause"),
    "BSD-3-Clause": ("BSD 3-Clause License", "3-Clause BSD License", "New BSD License", "BSD-3-Clause"),
    "GPL-2.0": ("GNU General Public License, version 2", "GNU General Public License version 2.0", "GNU General Public License v2.0", "GNU GPL v2", "GPLv2", "GPL-2.0"),
    "GPL-3.0": ("GNU General Public License, version 3", "GNU General Public License version 3.0", "GNU General Public License v3.0", "GNU GPL v3", "GPLv3", "GPL-3.0"),
    "LGPL-2.1": ("GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License v2.1", "GNU LGPL v2.1", "LGPLv2.1", "LGPL-2.1"),
    "LGPL-3.0": ("GNU Lesser General Public License, version 3", "GNU Lesser General Public License v3.0", "GNU LGPL v3", "LGPLv3", "LGPL-3.0"),
    "AGPL-3.0": ("GNU Affero General Public License, version 3", "GNU Affero General Public License v3.0", "GNU AGPL v3", "AGPLv3", "AGPL-3.0"),
    "MPL-2.0": ("Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "Mozilla Public License, v. 2.0", "MPL 2.0", "MPL-2.0"),
    "EPL-2.0": ("Eclipse Public License 2.0", "Eclipse Public License, version 2.0", "Eclipse Public License v2.0", "EPL-2.0"),
    "BSL-1.0": ("Boost Software License, Version 1.0", "Boost Software License 1.0"),
    "Zlib": ("zlib License", "zlib/libpng License"),
    "Unlicense": ("Unlicense",),
    "CC0-1.0": ("CC0 1.0", "CC0 1.0 Universal", "Creative Commons CC0 1.0 Universal", "Creative Commons Zero v1.0 Universal License"),
} | {  # Creative Commons
    f"CC-{k}-{v}": (f"CC {k} {v}", f"Creative Commons {name} {v} License", f"Creative Commons {name} {v} {where} License")
    for v, where in (("3.0", "Unported"), ("4.0", "International"))
    for k, name in (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"))
}
_WHAT = ("", "This work is ", "This project is ", "This software is ", "This code is ", "This library is ", "This file is ")
_HOW = ("licensed under ", "released under ", "distributed under ", "licensed under the terms of ")
_AFTER = (" - see the LICENSE file for details", ". See the LICENSE file for details", ". See LICENSE for details")
#: Notices of a licence's own appendix, whole and by its single lines where these name it.
NOTICES = (
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not'),
    ("Apache-2.0", "http://www.apache.org/licenses/LICENSE-2.0"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)"),
    *((f"{k}-{v}-or-later", f"This {what} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version {n} of the License, or (at your option) any later version.") for k, name, vs in (("GPL", "General Public License", ("2.0", "3.0")), ("LGPL", "Lesser General Public License", ("2.1", "3.0")), ("AGPL", "Affero General Public License", ("3.0",))) for v in vs for n in {v, v.removesuffix(".0")} for what in ("program", "library", "file")),
)


def catalogue() -> list[tuple[str, str]]:
    """(licence id, text) of everything that is known: whole texts with and without title and appendix, and notices."""
    out = list(KNOWN) + list(NOTICES)
    for path in sorted(TEXTS.glob("*.txt")):
        name, text = path.stem, path.read_text(encoding="utf-8")
        bodies = [text]
        if "END OF TERMS AND CONDITIONS" in text:  # without what comes after, and without that line
            body, _ = text.split("END OF TERMS AND CONDITIONS", 1)
            bodies += [body + "END OF TERMS AND CONDITIONS", body]
        bare = [t.split("\n", 1)[1] if any(t.strip().lower().startswith(x.lower()) for x in TITLES.get(name, ())) else t for t in (x.lstrip() for x in bodies)]
        out += [(name, t) for t in chain(bodies, bare, (f"{title}\n\n{t}" for title in TITLES.get(name, ()) for t in bare))]
    out += [(name, f"{title}\n\n{t}") for name, t in KNOWN[:2] for title in TITLES[name]]
    for k, n in ((k, n) for k, names in NAMES.items() for n in names):
        out += [(k, f"{what}{how}{the}{n}") for what in _WHAT for how in _HOW for the in ("", "the ")]
        out += [(k, f"{what}licensed under the {n}{after}") for what in ("", "This project is ") for after in _AFTER]
    for i in (TEXTS / "spdx_ids.csv").read_text().split():
        out.append((i, f"SPDX-License-Identifier: {i}"))
    return out


def known_digests(spark: SparkSession, known=None) -> DataFrame:
    """(digest, licence_id) of (licence id, text) pairs; of the package's table by default."""
    if known is None:
        with DIGESTS.open() as f:
            return spark.createDataFrame([(r["digest"], r["licence_id"]) for r in csv.DictReader(f)], "digest string, licence_id string")
    rows = spark.createDataFrame(list(known), "licence_id string, text string")
    found = rows.select(canonical(F.col("text")).alias("c"), "licence_id").where("c <> ''")
    return found.groupBy(F.sha2("c", 256).alias("digest")).agg(F.min("licence_id").alias("licence_id"))


def scanned(docs: DataFrame, known: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest, licence_id): licence_id of texts that are a known licence as a whole, else null."""
    known = known_digests(docs.sparkSession) if known is None else known
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.sha2(canonical(F.col(text_col)), 256).alias("digest"))
    return rows.join(known, "digest", "left").select("doc_id", "digest", "licence_id")


def notices(docs: DataFrame, known: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, line, licence_id): every line (from 0) that is a known licence or notice as a whole."""
    each = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.posexplode(F.split(F.col(text_col), "\n")).alias("line", "_line"))
    rows = each.select("doc_id", "line", F.sha2(canonical(F.col("_line")), 256).alias("digest"))
    return rows.join(known_digests(docs.sparkSession) if known is None else known, "digest").select("doc_id", "line", "licence_id")
