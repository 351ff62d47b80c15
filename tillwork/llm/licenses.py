"""Licence scans by canonical digest, in DataFrame functions only.

A text is brought to a canonical form (case, copyright lines, punctuation, equivalent spellings), the
whole of it is hashed, and the hash is joined to those of known licence texts treated the same way.
Whole texts are compared, and each line of a text by itself, since notices stand on a line of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillwork.llm.common import materialize, row_key, small

# Spellings taken as equal, from the word (in canonical form) to the one used for it.
SPELLINGS = {
    "acknowledgement": "acknowledgment", "analogue": "analog", "analyse": "analyze", "artefact": "artifact",
    "authorisation": "authorization", "authorised": "authorized", "calibre": "caliber", "cancelled": "canceled",
    "catalogue": "catalog", "centre": "center", "emphasised": "emphasized", "favour": "favor", "favourite": "favorite",
    "fulfil": "fulfill", "fulfilment": "fulfillment", "https": "http", "initialise": "initialize", "judgement": "judgment",
    "labelling": "labeling", "labour": "labor", "licence": "license", "licences": "licenses", "maximise": "maximize",
    "modelled": "modeled", "modelling": "modeling", "offence": "offense", "optimise": "optimize", "organisation": "organization",
    "organise": "organize", "practise": "practice", "programme": "program", "realise": "realize", "recognise": "recognize",
    "signalling": "signaling", "utilisation": "utilization", "whilst": "while", "wilful": "willful",
}
# Word pairs that are written as one word, with a hyphen or with a space.
COMPOUNDS = {"sub license": "sublicense", "non commercial": "noncommercial", "per cent": "percent", "non infringement": "noninfringement",
             "copyright owner": "copyright holder"}

_WARRANTY = ('THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE '
             "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
             "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
             "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.")
_ISC_WARRANTY = ('THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL '
                 "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
                 "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN "
                 "AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
                 "PERFORMANCE OF THIS SOFTWARE.")
_BSD_WARRANTY = ('THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, '
                 "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
                 "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
                 "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
                 "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
                 "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE "
                 "OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")
_BSD = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met:\n\n{}Redistributions of source code must retain the above copyright notice, this list of conditions and the "
        "following disclaimer.\n\n{}Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
        "the following disclaimer in the documentation and/or other materials provided with the distribution.\n\n")
_BSD_NAMES = ("{}Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
              "derived from this software without specific prior written permission.\n\n")
# Title lines that whole licences are often given.
TITLES = {"MIT": ["MIT License", "The MIT License", "The MIT License (MIT)"], "MIT-0": ["MIT No Attribution", "MIT No Attribution License"],
          "ISC": ["ISC License", "The ISC License", "ISC License (ISC)"], "0BSD": ["BSD Zero Clause License", "Zero-Clause BSD"],
          "BSD-2-Clause": ["BSD 2-Clause License", "The 2-Clause BSD License"],
          "BSD-3-Clause": ["BSD 3-Clause License", "The 3-Clause BSD License"]}
# Known texts by SPDX identifier. A licence may have several.
_TEXTS = [
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
            'files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, '
            "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
            "Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission "
            "notice shall be included in all copies or substantial portions of the Software.\n\n" + _WARRANTY),
    ("MIT-0", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
              'files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, '
              "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
              "Software is furnished to do so.\n\n" + _WARRANTY),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
            "provided that the above copyright notice and this permission notice appear in all copies.\n\n" + _ISC_WARRANTY),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\n"
             + _ISC_WARRANTY),
    *[("BSD-2-Clause", _BSD.format(*marks) + _BSD_WARRANTY) for marks in (("", ""), ("1. ", "2. "))],
    *[("BSD-3-Clause", _BSD.format(*marks) + _BSD_NAMES.format(*marks[2:]) + _BSD_WARRANTY) for marks in (("", "", ""), ("1. ", "2. ", "3. "))],
]
KNOWN = _TEXTS + [(name, f"{title}\n\n{text}") for name, text in _TEXTS for title in TITLES[name]] + [
    ("MIT", "Released under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
]


def canonical(text: Column) -> Column:
    """Lower case; lines that begin with a copyright statement dropped; all but letters and digits
    turned into single spaces; equivalent spellings replaced word by word. Null counts as empty."""
    out = F.lower(F.coalesce(text, F.lit("")))
    out = F.regexp_replace(out, r"(?m)^[ \t]*(copyright|©|\(c\)|all rights reserved)[^\n]*$", "")
    words = F.array_remove(F.split(out, r"[^\p{L}\p{N}]+"), "")
    table = F.create_map(*[F.lit(x) for pair in SPELLINGS.items() for x in pair])
    # One look at the text tells whether any word needs another spelling; few texts do.
    held = F.array_join(words, " ")
    spelled = F.array_join(F.transform(words, lambda w: F.coalesce(F.element_at(table, w), w)), " ")
    out = F.when(F.arrays_overlap(words, F.array(*[F.lit(w) for w in SPELLINGS])), spelled).otherwise(held)
    out = F.concat(F.lit(" "), out, F.lit(" "))
    for pair, word in COMPOUNDS.items():
        out = F.replace(out, F.lit(f" {pair} "), F.lit(f" {word} "))
    return F.trim(out)


def known_digests(spark: SparkSession, known=None) -> DataFrame:
    """(digest, license) of known texts; of equal texts under several identifiers the first in order."""
    texts = spark.createDataFrame(known or KNOWN, "license string, text string")
    return texts.groupBy(F.sha2(canonical(F.col("text")), 256).alias("digest")).agg(F.min("license").alias("license"))


def scan_licenses(docs: DataFrame, known: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, digest (of the canonical whole text), license (of the whole text, or
    null), notices (licences of single lines, sorted).

    `known`: digest, license. It is broadcast if small, else the digests are joined by a shuffle. Texts
    without a letter or digit have no licence. Rows that repeat are separate; other columns are not
    read; an empty table gives no rows.
    """
    known = small(materialize(known if known is not None else known_digests(docs.sparkSession), "licenses"))
    held = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    whole = held.select("id", row_key(F.col("id"), F.col("text")).alias("row"), F.sha2(canonical(F.col("text")), 256).alias("digest"))
    lines = (held.select(row_key(F.col("id"), F.col("text")).alias("line_row"), F.explode(F.split("text", "\n")).alias("line"))
             .select("line_row", F.sha2(canonical(F.col("line")), 256).alias("digest")))
    notices = (lines.join(known, "digest").groupBy("line_row").agg(F.array_sort(F.collect_set("license")).alias("notices")))   # names of licences
    named = whole.join(known, "digest", "left")
    return named.join(notices, named["row"] == notices["line_row"], "left").select(
        F.col("id").alias(id_col), "digest", "license", F.coalesce("notices", F.array().cast("array<string>")).alias("notices"))
