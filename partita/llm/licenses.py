"""Licence scan by canonical digests, with DataFrame expressions only.

A text is normalised (case, punctuation, copyright lines, equivalent spellings) and its digest is looked up among those of known
licence texts by a hash join; the same is done for each line among known one-line notices. Known texts go through
the same expressions, or are given by the digest of their normalised text. Lines that keep more letters than any known notice has are not digested.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: (pattern, replacement) on lower-cased text, in order; written so that Java and RE2 read them alike.
STEPS = (
    (r"(?m)^[ \t/*#;>-]*(?:copyright[ \t]*(?:\(c\)|©|[0-9<\[])|©|\(c\)[ \t]*[0-9<\[])[^\n]*(?:\n[ \t/*#;>-]*all rights reserved[. \t]*)?$", ""),
    (r"licen[cs]e", "license"),
    (r"sub-[ \n]?licens|sub licens", "sublicens"),
    (r"non-[ \n]?commercial|non commercial", "noncommercial"),
    (r"organisation", "organization"),
    (r"acknowledgement", "acknowledgment"),
    (r"favour", "favor"),
    (r"per cent", "percent"),
    (r"copyright owner", "copyright holder"),
    (r"&", " and "),
    (r"https?://(?:www\.)?", ""),
    (r"[\"'`´‘’“”„]+", ""),
    (r"[^\p{L}\p{N}]+", " "),
    (r"^ | $", ""),
)

#: Letters that STEPS delete at most for each match, beside whole copyright lines, which become empty.
LETTERS_LOST = ((r"https?://(?:www\.)?", 8), (r"acknowledgement|favour", 1))

_AS_IS_MIT = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
    "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
    "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_AS_IS_ISC = (
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF "
    "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
    "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF "
    "OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_BSD_HEAD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n"
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n"
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution.\n"
)
_BSD_TAIL = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED "
    "TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
    "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
    "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF "
    "LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS "
    "SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_PERMIT_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"

#: Known whole texts (licence id, text without its heading).
_BODIES = (
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions:\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the "
        "Software.\n" + _AS_IS_MIT,
    ),
    (
        "ISC",
        _PERMIT_ISC + ", provided that the above copyright notice and this permission notice appear in all copies.\n" + _AS_IS_ISC,
    ),
    ("0BSD", _PERMIT_ISC + ".\n" + _AS_IS_ISC),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_TAIL),
    (
        "BSD-3-Clause",
        _BSD_HEAD + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from "
        "this software without specific prior written permission.\n" + _BSD_TAIL,
    ),
)

#: Headings that a licence's text may stand under; the text without one counts as well.
HEADINGS = (
    ("MIT", ("The MIT License", "The MIT License (MIT)", "MIT License")),
    ("ISC", ("ISC License", "The ISC License", "ISC License (ISC)")),
    ("0BSD", ("Zero-Clause BSD", "BSD Zero Clause License", "Zero-Clause BSD License")),
    ("BSD-2-Clause", ("BSD 2-Clause License", "The 2-Clause BSD License", 'BSD 2-Clause "Simplified" License', "Simplified BSD License")),
    ("BSD-3-Clause", ("BSD 3-Clause License", "The 3-Clause BSD License", 'BSD 3-Clause "New" or "Revised" License', "New BSD License")),
)
#: Known whole texts (licence id, text).
TEXTS = _BODIES + tuple((name, f"{head}\n{body}") for name, heads in HEADINGS for known_name, body in _BODIES if known_name == name for head in heads)

#: Known licences (licence id, SHA-256 of the normalised text), each taken with normalized() from the text as its author publishes it. Fixed values:
#: "whole" is the file with its appendix, "terms" ends before the words "END OF TERMS AND CONDITIONS", "terms+end" with them.
DIGESTS = (
    ("Apache-2.0", "9923c3434173a86748f6d4f1e2dee5df77dd9cb5198b4a0819ba2c6b37991eae"),  # whole
    ("Apache-2.0", "a0b882a3520832f2052fec0e4dc03653cabce5bfd6c7395d7942c80d0bcf53ad"),  # terms
    ("Apache-2.0", "67b2cfda67ca97bcf37f8cf9ddc9cc915401f7c1d9e442adefe4e6db55b83ccb"),  # terms+end
    ("Artistic-1.0-Perl", "60a27c5baefcfa25bb55e89bed45c8878580548680242e16e413d8f7962caea2"),  # whole
    ("BSD-3-Clause", "21ce5e311a0ef74591e636cf6d0a236029bcaa0ee86324ac68d5748657aa8651"),  # whole
    ("CC0-1.0", "42e5c3e2dc951231f2f015709c4dce5e7c7b5cec0527b379b23e49bfafea1472"),  # whole
    ("GFDL-1.2", "7e1243154282c1bc79aab9dde8543ca0dc7808b9b825a3cfb40058a474e5592f"),  # whole
    ("GFDL-1.3", "1cb34c2aa4cd59b68095d69aafbac58a575e1dc66fb886d58889affee583b392"),  # whole
    ("GPL-1.0", "6a989e9e3800b7bc5300e632e9306911e14a7f4e0fddaae76ec5fb86a5b72225"),  # whole
    ("GPL-1.0", "16cef42e4238eaed7e49c177985d0566b1ee8cb7279dd8e058fe4bfe2eb71e7b"),  # terms
    ("GPL-1.0", "8649e3bbab1d552a05e410225fee7b9e1c8adc4774c7a91f780ec78a7649dd69"),  # terms+end
    ("GPL-2.0", "852dfae4a45171f05a0954d9a132503513f97774e4fddc650064b0262b771170"),  # whole
    ("GPL-2.0", "1b521fb21c7427f033dfb12ecd38a337a5ae335e3c24a55cdc3503b804a3d1c2"),  # terms
    ("GPL-2.0", "9874e4266f010abb577451f2573e333f5b02d45418605edc887f8ab670d29020"),  # terms+end
    ("GPL-3.0", "9e503558a0e7b087b4aa1a8a1a5bb26d53eb67f13185f34ba9287b50bf3836f6"),  # whole
    ("GPL-3.0", "6e425f409282069849afefa619bedb21d2210389ce56acb1575378a7cc8853a3"),  # terms
    ("GPL-3.0", "842fccbaaaa15a4e6a2b744f7be5205435cc2d3cb8d13e79f46edbe79a3369e2"),  # terms+end
    ("LGPL-2.0", "e6b557c836da67fa721172bd7f54e0cad02c6ffe1621ad4fd1d2823a1ed0cd29"),  # whole
    ("LGPL-2.0", "1fb0af2cffe08709bed2576c54534c042d87118c2f2f2a3fd64943e4d0e88ccb"),  # terms
    ("LGPL-2.0", "25f7e085a18d4bc8e4f6578b66c5b06dc1c91ba68fdeec775b6541a58ea17557"),  # terms+end
    ("LGPL-2.1", "73f8771023a7bd97f99604cee25be5ea96b506e8a15023953726f00bcf5e8cf9"),  # whole
    ("LGPL-2.1", "af577dff7052982dfe3f9fd1a0e3387b34e338043033265bfe6fdaa4a5245d30"),  # terms
    ("LGPL-2.1", "4c0e31071a3387f7e9a25974f05a970bc237220ca37b4f43dc9a1103959048aa"),  # terms+end
    ("LGPL-3.0", "91b5d3e9e307d305f7c91670699dcefa38a95bc0127f171027869fadcae9f986"),  # whole
    ("MPL-1.1", "f6be30b275d946b19361baa02ba175382d329549e743d253a980ca81c259aecb"),  # whole
    ("MPL-2.0", "296640d28b5a4745ec4d0aa90c23f408a3d9645bd224e67b131fc8e3fc31d88f"),  # whole
)

#: Known one-line notices (licence id, line).
NOTICES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "SPDX-License-Identifier: CC0-1.0"),
    ("proprietary", "All rights reserved."),
)


def normalized(text: Column) -> Column:
    out = F.lower(text)
    for pattern, put in STEPS:
        out = F.regexp_replace(out, pattern, put)
    return out


def known(spark: SparkSession, pairs) -> DataFrame:
    """(licence, digest, n) of known texts; of equal digests the first licence by name."""
    rows = spark.createDataFrame(list(pairs), "licence string, text string").withColumn("t", normalized(F.col("text")))
    return rows.where("t <> ''").groupBy(F.sha2(F.col("t").cast("binary"), 256).alias("digest"), F.char_length("t").alias("n")).agg(
        F.min("licence").alias("licence")
    )


def known_digests(spark: SparkSession, texts, digests) -> DataFrame:
    """(licence, digest) of known texts and of digests given as such; of equal digests the first licence by name."""
    given = spark.createDataFrame(list(digests), "licence string, digest string")
    both = known(spark, texts).select("licence", "digest").unionByName(given)
    return both.groupBy("digest").agg(F.min("licence").alias("licence"))


def scan(docs: DataFrame, texts=TEXTS, notices=NOTICES, digests=DIGESTS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: key, text_digest, licence (its whole text is that licence, else null), notices (ids of its notice lines, comma-joined, ordered, distinct; '' if none).

    Null or empty text, or one that normalises to nothing: no licence; its digest is that of the empty text. Rows of one key, null included, share
    their notices; each row stays. No rows: no rows. Very long texts are normalised and digested whole. Other columns are left out, whatever
    their names. texts, notices and digests may be of any size: they are broadcast only below Spark's own threshold.
    """
    spark = docs.sparkSession
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("_key"), t.alias("_t"))
    own = rows.select("_key", F.sha2(normalized(F.col("_t")).cast("binary"), 256).alias("text_digest"))
    whole = known_digests(spark, texts, digests).withColumnRenamed("digest", "text_digest")
    lines_known = known(spark, notices)
    # The steps delete no letter or digit but those of LETTERS_LOST: a line that keeps more than the longest notice has cannot become one.
    longest = lines_known.agg(F.max("n")).first()[0] or 0
    line = rows.select("_key", F.explode(F.split("_t", "\n", -1)).alias("_line")).where("_line <> ''")
    # Most lines are decided by their first letters: this pattern needs no more of a line than `longest` + 1 letters or digits.
    many = F.col("_line").rlike(rf"^(?:[^\p{{L}}\p{{N}}]*+[\p{{L}}\p{{N}}]){{{longest + 1}}}")
    low = F.lower("_line")
    loses = F.contains(low, F.lit("://")) | F.contains(low, F.lit("acknowledgement")) | F.contains(low, F.lit("favour"))
    kept = F.char_length(F.regexp_replace("_line", r"[^\p{L}\p{N}]+", ""))
    for pattern, most in LETTERS_LOST:
        kept = kept - most * F.regexp_count(low, F.lit(pattern))
    line = line.where(~many | (loses & (kept <= longest))).select("_key", normalized(F.col("_line")).alias("_n"))
    line = line.where((F.col("_n") != "") & (F.char_length("_n") <= longest)).select("_key", F.sha2(F.col("_n").cast("binary"), 256).alias("digest"))
    hits = line.join(lines_known.select("digest", "licence"), "digest").groupBy(F.col("_key").alias("_hit")).agg(
        F.array_join(F.array_sort(F.collect_set("licence")), ",").alias("notices")
    )
    out = own.join(whole, "text_digest", "left").join(hits, F.col("_key").eqNullSafe(F.col("_hit")), "left")
    return out.select(F.col("_key").alias(key), "text_digest", "licence", F.coalesce("notices", F.lit("")).alias("notices"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text_digest, licence, notices of all documents."""
    return scan(table(spark, sf_dir, "documents"))


def _sql() -> str:
    def lit(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    def norm(e: str) -> str:
        out = f"lower({e})"
        for pattern, put in STEPS:
            out = f"regexp_replace({out}, {lit(pattern)}, {lit(put)}, 'g')"
        return out

    def values(pairs) -> str:
        return ", ".join(f"({lit(a)}, {lit(b)})" for a, b in pairs)

    return f"""
WITH whole AS (
  SELECT digest, min(l) AS licence
  FROM (SELECT sha256({norm('t')}) AS digest, l FROM (VALUES {values(TEXTS)}) v(l, t) UNION ALL SELECT d, l FROM (VALUES {values(DIGESTS)}) g(l, d)) GROUP BY 1),
notice AS (SELECT sha256({norm('t')}) AS digest, min(l) AS licence FROM (VALUES {values(NOTICES)}) v(l, t) GROUP BY 1),
d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
hits AS (
  SELECT doc_id, string_agg(DISTINCT licence, ',' ORDER BY licence) AS notices
  FROM (SELECT doc_id, sha256({norm('line')}) AS digest FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d)) JOIN notice USING (digest)
  GROUP BY doc_id
), n AS (SELECT doc_id, sha256({norm('t')}) AS text_digest FROM d)
SELECT n.doc_id, text_digest, licence, coalesce(notices, '') AS notices
FROM n LEFT JOIN whole ON whole.digest = n.text_digest LEFT JOIN hits ON hits.doc_id = n.doc_id
"""


OP2_SQL = _sql()
