"""Toxicity scores from confirmed examples and unlabelled text: non-negative positive-unlabelled learning."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.llm.common import kept

#: Hashed features of the linear models.
DIMENSIONS = 1 << 18
#: Letters of the word beginnings that are features beside whole words.
STEM = 5
#: Documents that a classifier is fitted on at most: confirmed positives, and unlabelled ones (about, by a hash).
POSITIVES, UNLABELLED = 8192, 16384
#: Classifiers of different batch orders whose weights are averaged.
CLASSIFIERS = 3
CACHE = 200_000
#: Standard errors by which a feature must be more frequent among positives to be used.
SURPLUS = 5.0
#: Intercept at most: a text without a learned feature is never called toxic.
FLOOR = -1.0


def word_features(word: str) -> tuple[int, int]:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) % DIMENSIONS, zlib.crc32(b"^" + word[:STEM].encode("utf-8", "surrogatepass")) % DIMENSIONS


def features(text: str | None) -> np.ndarray:
    """Two features for every different lower-cased word of the whole text, stripped of marks around it."""
    words = {w.strip(".,;:!?\"'()[]") for w in (text or "").lower().split()}
    return np.array([f for w in sorted(words) if w for f in word_features(w)], np.int64)


def fit_nnpu(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, seed: int, epochs: int = 12, batch: int = 512, rate: float = 0.02) -> np.ndarray:
    """Weights and, last, the intercept of a logistic model, by Adam on the non-negative risk.

    The risk of negatives is what unlabelled text shows less the prior's share that positives explain; where a batch makes it
    negative, the step goes up that part alone, so the model cannot learn the unlabelled positives as negatives.
    """
    rng = np.random.default_rng(seed)
    w, m, v = np.zeros(DIMENSIONS + 1), np.zeros(DIMENSIONS + 1), np.zeros(DIMENSIONS + 1)
    w[-1] = np.log(prior / (1 - prior))
    steps = max(1, -(-len(unlabelled) // batch)) * epochs
    take = max(1, min(len(positive), batch // 2))

    def margins(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sizes = np.array([len(r) for r in rows])
        at = np.concatenate(rows) if sizes.sum() else np.zeros(0, np.int64)
        who = np.repeat(np.arange(len(rows)), sizes)
        return np.bincount(who, w[at], len(rows)) + w[-1], at, who

    for t in range(1, steps + 1):
        p = [positive[i] for i in rng.choice(len(positive), take, replace=False)]
        u = [unlabelled[i] for i in rng.choice(len(unlabelled), min(batch, len(unlabelled)), replace=False)]
        fp, at_p, who_p = margins(p)
        fu, at_u, who_u = margins(u)
        sp, su = 1 / (1 + np.exp(-np.clip(fp, -30, 30))), 1 / (1 + np.exp(-np.clip(fu, -30, 30)))
        negative = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
        gu, gp_neg, gp_pos = su / len(u), -prior * sp / len(p), -prior * (1 - sp) / len(p)
        if negative >= 0:
            du, dp = gu, gp_neg + gp_pos
        else:
            du, dp = -gu, -gp_neg
        g = np.bincount(at_u, du[who_u], DIMENSIONS + 1) + np.bincount(at_p, dp[who_p], DIMENSIONS + 1)
        g[-1] = du.sum() + dp.sum()
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def surplus(positive: np.ndarray, unlabelled: np.ndarray, p: int, u: int) -> np.ndarray:
    """Which features' share of ``p`` positive texts exceeds that of ``u`` unlabelled ones by ``SURPLUS`` standard errors.

    The others are noise to so small a sample; in a long text their many small weights would outdo the few that tell.
    """
    share = (positive + unlabelled) / (p + u)
    error = np.sqrt(share * (1 - share) * (1 / p + 1 / u))
    return positive / p - unlabelled / u >= SURPLUS * np.maximum(error, 1e-9)


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, seed: int) -> np.ndarray:
    """``fit_nnpu``, its intercept set so that the prior's share of the unlabelled texts scores a half or more."""
    w = fit_nnpu(positive, unlabelled, prior, seed)
    margins = np.array([w[r].sum() for r in unlabelled])
    w[-1] = min(FLOOR, -float(np.quantile(margins, 1 - prior)))
    return w


def _extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame({"positive": batch["positive"], "mark": batch["mark"], "features": [features(t).astype("<i4").tobytes() for t in batch["text"]]})


def _tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    sums = np.zeros((2, DIMENSIONS), np.int64)
    for batch in batches:
        for positive, own in zip(batch["positive"], batch["features"], strict=True):
            sums[0 if positive else 1][np.unique(np.frombuffer(own, "<i4"))] += 1
    some = np.flatnonzero(sums.any(axis=0))
    yield pd.DataFrame({"feature": some, "p": sums[0][some], "u": sums[1][some]})


def _only(use: bytes):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wanted = np.unpackbits(np.frombuffer(use, np.uint8)).astype(bool)
        for batch in batches:
            own = [np.frombuffer(f, "<i4") for f in batch["features"]]
            yield batch.assign(features=[f[wanted[f]].tobytes() for f in own])

    return run


def _fit(prior: float) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("mark", kind="stable")
        sets = [[np.frombuffer(f, "<i4").astype(np.int64) for f in rows.loc[rows["positive"] == k, "features"]] for k in (True, False)]
        return pd.DataFrame({"seed": [int(key[0])], "weights": [fit(*sets, prior, int(key[0])).astype("<f8").tobytes()]})

    return run


def learn(docs: DataFrame, labels: DataFrame, allowed: Column | None = None, id: str = "doc_id", text: str = "text", label: str = "toxic") -> np.ndarray:
    """Mean weights of ``CLASSIFIERS`` models, each fitted in a task of its own.

    ``allowed`` says which ids labels may be learned from.  Positives are the allowed ids labelled 1, at most ``POSITIVES`` of them
    (smallest hash first); their ids are few enough to be sent to every task.  Unlabelled text is about ``UNLABELLED`` of
    all other allowed documents, chosen by a hash of their id whatever their label.  The sample's features are a written table; tasks
    count them, and a model's task gets the telling ones alone, never a text.  The class prior is the share of ones among
    the allowed labels, kept within 0.001 and 0.5.  Null labels and ids are left out; repeated rows count as one label.
    """
    mine = labels.select(F.col(id).alias("id"), F.col(label).cast("int").alias("label")).where("id is not null and label is not null")
    rows = docs.select(F.col(id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).where("id is not null")
    if allowed is not None:
        mine, rows = mine.where(allowed), rows.where(allowed)
    mine = mine.groupBy("id").agg(F.max("label").alias("label"))
    share = mine.agg(F.avg("label")).first()[0]
    prior = min(0.5, max(0.001, share or 0.0))
    mark = F.xxhash64("id")
    chosen = mine.where("label = 1").select("id").orderBy(mark, "id").limit(POSITIVES)
    n = rows.select("id").distinct().count()
    part = F.pmod(mark, F.lit(1 << 30)) < int(min(1.0, UNLABELLED / max(n, 1)) * (1 << 30))
    positive = rows.join(F.broadcast(chosen), "id").dropDuplicates(["id"]).withColumn("positive", F.lit(True))
    other = rows.where(part).dropDuplicates(["id"]).withColumn("positive", F.lit(False))
    sample = positive.unionByName(other).select("positive", mark.alias("mark"), "text")
    sample = kept(sample.mapInPandas(_extract, "positive boolean, mark long, features binary"), "sample")
    sizes = {r["positive"]: r["n"] for r in sample.groupBy("positive").agg(F.count("*").alias("n")).collect()}
    nothing = np.zeros(DIMENSIONS + 1)
    nothing[-1] = np.log(prior / (1 - prior))
    if len(sizes) < 2:
        return nothing
    counts = sample.mapInPandas(_tally, "feature long, p long, u long").groupBy("feature").agg(F.sum("p").alias("p"), F.sum("u").alias("u")).toPandas()  # at most DIMENSIONS rows
    by = np.zeros((2, DIMENSIONS))
    by[:, counts["feature"]] = counts[["p", "u"]].to_numpy().T
    use = np.packbits(surplus(by[0], by[1], sizes[True], sizes[False])).tobytes()
    telling = sample.mapInPandas(_only(use), sample.schema).withColumn("seed", F.explode(F.array(*[F.lit(i) for i in range(CLASSIFIERS)])))
    fitted = telling.groupBy("seed").applyInPandas(_fit(prior), "seed int, weights binary").collect()
    return np.mean([np.frombuffer(r["weights"], "<f8") for r in fitted], axis=0)


class _WordWeights(dict):
    """Weight of a word, computed at its first use."""

    def __init__(self, weights: list[float]):
        self.weights = weights

    def __missing__(self, word: str) -> float:
        if len(self) >= CACHE:
            self.clear()
        bare = word.strip(".,;:!?\"'()[]")
        a, b = word_features(bare)
        self[word] = out = (bare, self.weights[a] + self.weights[b]) if bare else (bare, 0.0)
        return out


def score_column(weights: np.ndarray, text: Column) -> Column:
    """Chance of toxicity, 0 to 1, of the whole text; null and empty texts have the intercept's."""
    packed = weights.astype("<f4").tobytes()

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        w = np.frombuffer(packed, "<f4").tolist()
        known = _WordWeights(w)
        for texts in batches:
            out = np.array([w[-1] + sum(dict(map(known.__getitem__, set(t.lower().split()))).values()) if t else w[-1] for t in texts], float)
            yield pd.Series(1 / (1 + np.exp(-np.clip(out, -30, 30))))

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "double")(text)


def held_out(id: Column) -> Column:
    """Whether an id is in the fifth that no label is learned from; null ids are not."""
    return F.coalesce(F.crc32(id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def score(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: id, ``held_out``, ``score``, ``predicted``.  An empty table gives no rows; other columns are not read."""
    weights = learn(docs, labels, ~held_out(F.col("id")), id, text)
    rows = docs.select(F.col(id).alias(id), score_column(weights, F.col(text)).alias("score"))
    return rows.select(id, held_out(F.col(id)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
