"""Language identification by rank-order n-gram profiles.

A profile is the list of the most frequent n-grams (1 to 3 characters of lower-cased words, with a mark at word ends). A text
is given the language whose profile is nearest by out-of-place distance: for each n-gram of the text's own profile the
difference of its two ranks, or the profile's length where the language lacks it.

Profiles are learned from at most ``per_lang`` labelled texts of each language (whole texts, chosen by a hash of the id), and
languages x ``top`` rows are all that goes to the driver and back to the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import table

TOP = 400
PER_LANG = 2000
UND = "und"
BITS = 21


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Per code point its lower-case form, 0 where it is no letter."""
    lower = np.zeros(0x110000, np.int64)
    for c in (*range(0xD800), *range(0xE000, 0x110000)):
        if chr(c).isalpha():
            lower[c] = ord(chr(c).lower()[0])
    return lower


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of a whole text as packed code points plus 1, ascending, and their counts. No letter: none.

    Each run of other characters is one word end, coded 1; 3-grams across word ends are left out.
    """
    none = np.empty(0, np.int64)
    if not text:
        return none, none
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    chars = _letters()[points]
    if not chars.any():
        return none, none
    chars = np.concatenate(([0], chars, [0]))
    chars = chars[(chars > 0) | (np.concatenate(([1], chars[:-1])) > 0)] + 1
    two = chars[:-1] << BITS | chars[1:]
    three = two[:-1] << BITS | chars[2:]
    return np.unique(np.concatenate((chars[chars > 1], two, three[chars[1:-1] > 1])), return_counts=True)


def _top(keys: np.ndarray, counts: np.ndarray, top: int) -> np.ndarray:
    """The most frequent grams in rank order; ties by the packed value."""
    if len(keys) > 4 * top:
        least = np.partition(counts, len(counts) - top)[len(counts) - top]
        keep = counts >= least
        keys, counts = keys[keep], counts[keep]
    return keys[np.lexsort((keys, -counts))[:top]]


def learn_profiles(
    labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", top: int = TOP, per_lang: int = PER_LANG
) -> dict[str, list[int]]:
    """Profiles {lang: grams in rank order} from rows whose text and lang are not null.

    At most per_lang texts of each language, those of the smallest key hashes; texts without a letter add nothing. No rows: {}.
    """
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(key).alias("_k"), F.col(lang).alias("_lang"), F.col(text).alias("_text")
    )
    order = Window.partitionBy("_lang").orderBy(F.xxhash64("_k"), "_k")
    chosen = rows.select("_k", "_lang").withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= per_lang).select("_k", "_lang").distinct()
    sample = rows.join(F.broadcast(chosen), ["_k", "_lang"], "left_semi")  # languages x per_lang ids at most

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, dict[int, int]] = {}
        for pdf in batches:
            for code, t in zip(pdf["_lang"], pdf["_text"], strict=True):
                own = sums.setdefault(code, {})
                for k, n in zip(*(x.tolist() for x in grams(t)), strict=True):
                    own[k] = own.get(k, 0) + n
            if sum(map(len, sums.values())) > 500_000:
                yield from flush(sums)
                sums = {}
        yield from flush(sums)

    def flush(sums: dict[str, dict[int, int]]) -> Iterator[pd.DataFrame]:
        for code, own in sums.items():
            yield pd.DataFrame({"lang": code, "gram": list(own), "n": list(own.values())}).astype({"gram": "int64", "n": "int64"})

    counted = sample.select("_lang", "_text").mapInPandas(count, "lang string, gram long, n long")
    total = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    ranked = total.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= top).select("lang", "rank", "gram")
    out: dict[str, list[tuple[int, int]]] = {}
    for r in ranked.collect():  # languages x top
        out.setdefault(r["lang"], []).append((r["rank"], r["gram"]))
    return {k: [g for _, g in sorted(v)] for k, v in sorted(out.items())}


class RankOrder:
    """Out-of-place distances to all profiles at once."""

    def __init__(self, profiles: dict[str, list[int]], top: int = TOP):
        self.langs, self.top = list(profiles), top
        self.keys = np.unique(np.concatenate([np.asarray(p, np.int64) for p in profiles.values()])) if profiles else np.empty(0, np.int64)
        self.ranks = np.full((len(self.keys), len(profiles)), -1, np.int64)
        for j, p in enumerate(profiles.values()):
            self.ranks[np.searchsorted(self.keys, p), j] = np.arange(len(p))

    def predict(self, text: str | None) -> tuple[str, float]:
        """(lang, score): score is 1 minus the distance over the largest possible; ties go to the first language by name."""
        keys, counts = grams(text)
        if not len(keys) or not self.langs:
            return UND, 0.0
        own = _top(keys, counts, self.top)
        at = np.searchsorted(self.keys, own)
        at[at == len(self.keys)] = 0
        ranks = np.where((self.keys[at] == own)[:, None], self.ranks[at], -1)
        away = np.where(ranks >= 0, np.abs(ranks - np.arange(len(own))[:, None]), self.top).sum(axis=0)
        best = int(np.argmin(away))
        return self.langs[best], float(1 - away[best] / (self.top * len(own)))


def identify(df: DataFrame, profiles: dict[str, list[int]], text: str = "text", top: int = TOP) -> DataFrame:
    """df with lang_pred string and score double. Null text or no letter: und, 0. Columns of these names are replaced.

    Each row on its own, so repeated rows get equal results; no rows: no rows. No profiles: und.
    """
    rest = [f for f in df.schema.fields if f.name not in ("lang_pred", "score")]
    model = RankOrder(profiles, top)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [model.predict(None if t is None or t != t else t) for t in pdf[text]]
            yield pdf.assign(lang_pred=[g[0] for g in got], score=[g[1] for g in got])

    base = df.select(*[F.col(f"`{f.name}`") for f in rest])
    schema = StructType([*base.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return base.mapInPandas(run, schema)


def held_out():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract: doc_id, held_out, lang_pred, score. Learns only from documents that are not held out."""
    docs = table(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(held_out(), F.lit(False)))
    profiles = learn_profiles(docs.where(~F.col("held_out")))
    return identify(docs.select("doc_id", "held_out", "text"), profiles).drop("text")
