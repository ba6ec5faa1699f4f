"""Importance resampling: hashed n-gram models of target and raw text, Gumbel top-k."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.llm.common import kept

BUCKETS = 10_000
#: Added to every bucket's count in both models.
SMOOTHING = 1.0
CACHE = 200_000
#: Rows of a narrowed range of keys that are sorted to find a rank.
RANGE = 10_000


class _Words(dict):
    """Hash of a word, computed at its first use."""

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        self[word] = out = zlib.crc32(word.encode("utf-8", "surrogatepass"))
        return out


def ngram_buckets(text: str | None, known: dict[str, int] | None = None, buckets: int = BUCKETS) -> np.ndarray:
    """Bucket of every word and pair of neighbouring words of the whole text, marks apart from words."""
    words = (text or "").split()
    h = np.fromiter(map((_Words() if known is None else known).__getitem__, words), np.uint64, len(words))
    pairs = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:] * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(20)
    return np.concatenate([h, pairs]) % np.uint64(buckets)


def _count(buckets: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, sums = _Words(), np.zeros((2, buckets), np.int64)
        for batch in batches:
            for text, target in zip(batch["text"], batch["target"], strict=True):
                n = np.bincount(ngram_buckets(text, known, buckets).astype(np.int64), minlength=buckets)
                sums[0] += n
                if target:
                    sums[1] += n
        yield pd.DataFrame({"bucket": np.arange(buckets), "raw": sums[0], "target": sums[1]})

    return run


def log_ratios(marked: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Log of each bucket's probability in target over raw text; ``marked`` has ``text`` and ``target`` of all documents.

    Every task sums its own documents; ``buckets`` rows a task are shuffled.
    """
    sums = marked.select("text", "target").mapInPandas(_count(buckets), "bucket long, raw long, target long")
    rows = sums.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect()  # one row a bucket
    raw, target = np.full(buckets, SMOOTHING), np.full(buckets, SMOOTHING)
    for r in rows:
        raw[r["bucket"]] += r["raw"]
        target[r["bucket"]] += r["target"]
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def weight_column(ratios: np.ndarray, text: Column) -> Column:
    packed, buckets = ratios.astype("<f8").tobytes(), len(ratios)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        table, known = np.frombuffer(packed, "<f8"), _Words()
        for texts in batches:
            yield pd.Series([float(table[ngram_buckets(t, known, buckets).astype(np.int64)].sum()) for t in texts], dtype="float64")

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "double")(text)


def gumbel(seed: int, *keys: Column) -> Column:
    """Standard Gumbel noise of a hash of the keys: the same for the same row wherever it is drawn."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *keys), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    return -F.log(-F.log(u))


def kth_largest(rows: DataFrame, column: str, k: int) -> float:
    """The value of rank ``k`` (from 1) from above, by counts in ever narrower ranges; at most ``RANGE`` rows are ordered at the end."""
    lo, hi = rows.agg(F.min(column), F.max(column)).first()
    while True:
        part = rows.where(F.col(column).between(lo, hi))
        slot = F.least(F.floor((F.col(column) - lo) / ((hi - lo) / 1024 or 1.0)), F.lit(1023))
        counts = part.groupBy(slot.alias("slot")).agg(F.count("*").alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).orderBy(F.desc("slot")).collect()
        for c in counts:
            if k <= c["n"]:
                break
            k -= c["n"]
        if c["lo"] == c["hi"]:
            return c["lo"]
        if c["n"] <= RANGE:
            return part.where(F.col(column).between(c["lo"], c["hi"])).orderBy(F.desc(column)).limit(k).agg(F.min(column)).first()[0]
        lo, hi = c["lo"], c["hi"]


def resample(docs: DataFrame, labels: DataFrame, share: float | None = None, id: str = "doc_id", text: str = "text", label: str = "quality", seed: int = 17, buckets: int = BUCKETS) -> DataFrame:
    """A sample of the documents towards the target: id, ``log_weight``, ``key``, largest keys.

    Target text is that of documents labelled 1, raw text that of all documents.  A document's weight is the ratio of its
    probabilities under the two models over hashed words and pairs; the rows of the k largest keys (log weight plus Gumbel noise) are
    a draw without replacement.  k is ``share`` of the rows, or where none is given the share of ones among labels.  Rows
    with the k-th key itself all stay, so repeated rows stay or go together.  Null and empty texts have log weight 0; null
    labels count as none; an id labelled twice is target if any label is 1; an empty table gives no rows.
    """
    known = labels.select(F.col(id).alias("id"), F.col(label).cast("int").alias("label")).where("id is not null and label is not null").groupBy("id").agg(F.max("label").alias("label"))
    rows = docs.select(F.col(id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    if share is None:
        share = known.agg(F.avg((F.col("label") == 1).cast("double"))).first()[0]
    target = known.where("label = 1").select("id", F.lit(True).alias("target"))
    # the labels grow with the documents: one plan at every size
    ratios = log_ratios(rows.join(target.hint("merge"), "id", "left").withColumn("target", F.coalesce("target", F.lit(False))), buckets)
    weighed = rows.select("id", F.xxhash64("text").alias("_h"), weight_column(ratios, F.col("text")).alias("log_weight"))
    keys = kept(weighed.select("id", "log_weight", (F.col("log_weight") + gumbel(seed, F.col("id"), F.col("_h"))).alias("key")), "keys")
    n = keys.count()
    k = round(n * (1.0 if share is None else share))
    out = keys.where(F.col("key") >= kth_largest(keys, "key", k)) if k else keys.where("false")
    return out.withColumnRenamed("id", id)
