"""Quality rules as a short-circuit cascade, with DataFrame expressions only.

A rule is a condition that rejects. On a sample of bounded size the share of rows that each rule rejects and the time
it takes are measured; the rules are put in order of rejections per cost, and one CASE asks them in that order, so what one
rule rejects is not given to the next. The order changes the time alone: a row is kept if no rule rejects it.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, WORD, packed, table, unpacked

WINDOW = 8
#: Rows on which costs and selectivities are estimated, at most.
SAMPLE = 1_000
#: Evaluations of a rule on each sampled row, and the column that counts them.
TIMES, TIMES_COLUMN = 16, "evaluation of a rule"


@dataclass(frozen=True)
class Rule:
    """reject: from the text column (never null) to a condition; it may also use columns of base_statistics."""

    name: str
    reject: Callable[[Column], Column]


def _share(count: str, of: str) -> Column:
    return F.col(count) / F.greatest(F.col(of), F.lit(1))


def _letters(t: Column) -> Column:
    return F.greatest(F.regexp_count(t, F.lit(r"\p{L}")), F.lit(1))


RULES = (
    Rule("few_words", lambda t: F.col("n_words") < 20),
    Rule("repeats", lambda t: F.col("n_repeat_words") * 100 > F.col("n_words") * 30),
    Rule("symbols", lambda t: F.col("n_symbols") * 10 > F.col("n_words")),
    Rule("short_words", lambda t: F.col("word_chars") < F.col("n_words") * 2),
    Rule("long_words", lambda t: F.col("word_chars") > F.col("n_words") * 15),
    Rule("dup_lines", lambda t: F.col("n_dup_lines") * 2 > F.col("n_words")),
    Rule("capitals", lambda t: F.regexp_count(t, F.lit(r"\p{Lu}")) * 2 > _letters(t)),
    Rule("digits", lambda t: F.regexp_count(t, F.lit(r"\p{Nd}")) > _letters(t)),
)


def base_statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """df with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text column (null: no words). Such columns are replaced, any
    other names stay. Very long texts count whole.

    n_repeat_words: words in 8-word windows found twice or more in the text, the first included. Windows are hashed; only where two
    are equal are they sorted with their places. Places in order, each covers up to the next or its window's end.
    """
    out = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    mine = [c for c in df.columns if c not in out]
    keep = ["row"]
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(WORD))
    step = df.select(
        packed(df),
        F.transform(F.filter(F.split(t, SPACES, -1), lambda w: w != ""), lambda w: F.xxhash64(w)).alias("_h"),
        (F.char_length(t) - F.regexp_count(t, F.lit(r"[\x20\x09-\x0D]"))).cast("long").alias("word_chars"),
        F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        lines.alias("_l"),
    )
    window = lambda i: F.xxhash64(*[F.get(F.col("_h"), i + j) for j in range(WINDOW)])
    step = step.select(
        *keep,
        F.size("_h").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("_h") >= WINDOW, F.transform(F.sequence(F.lit(0), F.size("_h") - WINDOW), window)).alias("_k"),
    )
    twice = F.size(F.array_distinct("_k")) < F.size("_k")
    step = step.withColumn("_p", F.when(twice, F.array_sort(F.transform("_k", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))).drop("_k")
    same = lambda p, i: (i >= 0) & (F.get(F.col("_p"), i)["h"] == p["h"])
    hit = F.filter("_p", lambda p, i: F.coalesce(same(p, i - 1), F.lit(False)) | F.coalesce(same(p, i + 1), F.lit(False)))
    step = step.withColumn("_p", F.array_sort(F.transform(hit, lambda p: p["i"])))
    covered = F.aggregate(
        F.transform("_p", lambda p, i: F.least(F.coalesce(F.get(F.col("_p"), i + 1) - p, F.lit(WINDOW)), F.lit(WINDOW))),
        F.lit(0),
        lambda a, n: a + n,
    )
    step = step.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
    return step.select(*unpacked(mine), *out)


def order_rules(df: DataFrame, rules=RULES, text: str = "text", sample: int = SAMPLE) -> list[Rule]:
    """The rules by rejected share of a sample per second of work, most first; equal ones stay as given.

    The sample is the `sample` rows with the smallest hashes of the whole row. A rule's cost is the time of a job that evaluates it TIMES times on
    each of them, less that of the same job without a rule.
    """
    rows = base_statistics(df.orderBy(F.xxhash64(packed(df))).limit(sample), text).persist()
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    try:
        n = max(1, rows.count())
        often = rows.select("*", F.explode(F.sequence(F.lit(1), F.lit(TIMES))).alias(TIMES_COLUMN))

        def timed(hit: Column) -> tuple[int, float]:
            began = time.perf_counter()
            hits = often.agg(F.count_if(hit)).first()[0]
            return hits, time.perf_counter() - began

        idle = F.col(TIMES_COLUMN) < 0
        base = min(timed(idle)[1] for _ in range(2))
        rated = []
        for k, r in enumerate(rules):
            hits, cost = timed(r.reject(t))
            rated.append((-(hits / n / TIMES) / max(cost - base, 1e-3), k))
        return [rules[k] for _, k in sorted(rated)]
    finally:
        rows.unpersist()


def cascade(rules: list[Rule], text: str = "text") -> Column:
    """kept: false at the first rule that rejects, else true."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    out = F.when(F.lit(False), False)
    for r in rules:
        out = out.when(F.coalesce(r.reject(t), F.lit(False)), False)
    return out.otherwise(True)


def quality_filter(df: DataFrame, text: str = "text", rules=RULES, sample: int = SAMPLE) -> DataFrame:
    """df with the base statistics and kept. The statistics are part of the result, so all rows have them; what only a rule needs is computed
    where the rules before it do not reject. Null or empty text: no words, so rejected as too short. Equal rows: equal results. No rows: no rows."""
    stats = base_statistics(df, text)
    return stats.withColumn("kept", cascade(order_rules(df, rules, text, sample), text))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept."""
    got = quality_filter(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)
    return got.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (F.col("kept") & ~base).alias("kept")
    )


OP5_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
wins AS (
  SELECT doc_id, i, array_to_string(w[i:i+7], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)
), hits AS (SELECT doc_id, i FROM wins QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
reps AS (
  SELECT doc_id, sum(least(8, coalesce(nxt - i, 8)))::BIGINT AS n
  FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM hits) GROUP BY doc_id
), dups AS (
  SELECT doc_id, (count(*) - count(DISTINCT l))::BIGINT AS n
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id
), s AS (
  SELECT d.doc_id, t, len(w)::BIGINT AS n_words,
    length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    coalesce(dups.n, 0) AS n_dup_lines, coalesce(reps.n, 0) AS n_repeat_words
  FROM d LEFT JOIN dups USING (doc_id) LEFT JOIN reps USING (doc_id)
), b AS (SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
    greatest(len(regexp_extract_all(t, '\p{L}')), 1) AS letters FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR n_symbols * 10 > n_words OR word_chars < n_words * 2 OR word_chars > n_words * 15 OR n_dup_lines * 2 > n_words
    OR len(regexp_extract_all(t, '\p{Lu}')) * 2 > letters OR len(regexp_extract_all(t, '\p{Nd}')) > letters) AS kept
FROM b
"""
