"""Near-duplicates by SimHash fingerprints and covering locality-sensitive hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from skyloom.llm.common import components, kept

BITS = 64
SEED = 42
#: The words of a byte's eight bits: row v has bit i of v in column i.
BYTE_BITS = (np.arange(256)[:, None] >> np.arange(8)) & 1
LOWERED = bytes(range(256)).lower()
#: Fingerprints of a bucket that are compared in one task; a larger bucket is covered again by finer masks.
BUCKET = 2048


def shingle_hashes(text: str | None, words: int = 3, seed: int = SEED) -> np.ndarray:
    """XXH64 of every shingle of ``words`` ASCII-lower-cased words, repeats included."""
    tokens = (text or "").encode("utf-8", "surrogatepass").translate(LOWERED).split()
    if not tokens:
        return np.zeros(0, np.uint64)
    joined = b" ".join(tokens)
    if len(tokens) <= words:
        return np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1)
    first = [0, *ends[:-words].tolist()]
    last = (ends[words - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter([digest(joined[i:j], seed) for i, j in zip(first, last, strict=True)], np.uint64, len(last))


def vote(hashes: np.ndarray) -> int:
    """Bit i is one where over half of the hashes have it; no hash gives nought."""
    by_byte = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    ones = np.concatenate([np.bincount(by_byte[:, j], minlength=256) @ BYTE_BITS for j in range(8)])
    return int(((2 * ones > len(hashes)).astype(np.uint64) << np.arange(BITS, dtype=np.uint64)).sum(dtype=np.uint64))


@F.pandas_udf(LongType())
def _fingerprint(texts: pd.Series, words: pd.Series) -> pd.Series:
    w = int(words.iloc[0]) if len(words) else 3
    return pd.Series([vote(shingle_hashes(t, w)) for t in texts], dtype="uint64").astype("int64")


def fingerprint(text: Column, words: int = 3) -> Column:
    """The signed 64-bit fingerprint of a text; null and empty texts have nought."""
    return _fingerprint(text, F.lit(words))


def covering_masks(radius: int, level: int = 0) -> list[int]:
    """Masks of which at least one misses any ``radius`` positions.

    Position i gets a non-zero vector of radius + 1 bits; mask v keeps the positions whose vector has an odd product with v.
    The vectors of ``radius`` positions never span the whole space, so some v is orthogonal to all of them.  The vectors are
    dealt evenly, in an order that changes with ``level``, so every mask keeps about half of any earlier mask's free bits.
    """
    kinds = (1 << (radius + 1)) - 1
    order = np.random.default_rng([radius, level]).permutation(BITS)
    vector = np.empty(BITS, np.int64)
    vector[order] = 1 + np.arange(BITS) % kinds
    return [sum(1 << i for i in range(BITS) if int(vector[i] & v).bit_count() % 2) for v in range(1, kinds + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _spanning(members: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A forest over the members that links what chains of near members connect: (member, smaller member of its tree)."""
    left = np.sort(members)
    bits = left.view(np.uint64)
    out: list[tuple[int, int]] = []
    while len(left):
        inside = np.zeros(len(left), bool)
        inside[0] = True
        front = np.array([0])
        while len(front):
            near = np.zeros(len(left), bool)
            for at in range(0, len(front), 256):
                near |= (np.bitwise_count(bits[front[at : at + 256], None] ^ bits[None, :]) <= radius).any(axis=0)
            front = np.flatnonzero(near & ~inside)
            inside |= near
        root = int(left[0])
        out += [(int(x), root) for x in left[inside][1:]]
        left, bits = left[~inside], bits[~inside]
    return out


def _edges_of(radius: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = {e for m in batch["members"] for e in _spanning(np.asarray(m, np.int64), radius)}
            yield pd.DataFrame(sorted(found), columns=["a", "b"], dtype="int64")

    return run


def near_edges(fingerprints: DataFrame, radius: int = 3, bucket: int = BUCKET) -> DataFrame:
    """Links ``(a, b)`` between different fingerprints whose chains connect all that differ in ``radius`` bits or fewer.

    ``fingerprints`` has distinct values ``fp``.  Every table keeps one mask's bits as its key.  Buckets of two are compared
    as they are, larger ones in one task each; a bucket over ``bucket`` members goes through a further level of masks on its
    free bits instead, and so on.  As free bits halve with every level while members are distinct, this ends with
    buckets of at most max(``bucket``, 2 ** free bits) members, and no pair is lost.  (Where no more than ``radius`` bits
    are free, some mask adds none of them: ``bucket`` counts as twice 2 ** ``radius`` at least.)  Only forests come out, never a
    bucket's pairs.
    """
    bucket = max(bucket, 2 << radius)
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius
    rows = fingerprints.select("fp", F.lit(0).cast("long").alias("mask"))
    out, level = [], 0
    while True:
        masks = F.array(*[F.lit(_signed(m)) for m in covering_masks(radius, level)])
        rows = rows.select("fp", F.explode(F.transform(masks, lambda m: m.bitwiseOR(F.col("mask")))).alias("mask"))
        rows = rows.distinct() if level else rows
        rows = rows.withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
        sizes = rows.groupBy("mask", "key").agg(F.count("*").alias("n"), F.min("fp").alias("b"), F.max("fp").alias("a")).where("n > 1")
        sizes = kept(sizes, "buckets")
        out.append(sizes.where("n = 2").select("a", "b").where(near))
        some = sizes.where(f"n > 2 and n <= {bucket}").select("mask", "key")
        lists = rows.join(some, ["mask", "key"]).groupBy("mask", "key").agg(F.collect_list("fp").alias("members"))
        out.append(lists.select("members").mapInPandas(_edges_of(radius), "a long, b long"))
        large = sizes.where(f"n > {bucket}").select("mask", "key")
        if large.isEmpty():
            break
        rows = kept(rows.join(large, ["mask", "key"], "left_semi").select("fp", "mask").repartition("fp", "mask"), "large")
        level += 1
    edges = out[0]
    for e in out[1:]:
        edges = edges.unionByName(e)
    return edges.distinct()


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", words: int = 3, radius: int = 3) -> DataFrame:
    """One row a document: its id, ``fp`` (signed) and ``component_id``, the smallest id that links reach from it.

    Equal fingerprints are one node, so a group of copies of any size costs one row a table.  Null texts count as empty; texts
    without words have fingerprint nought and link like any other.  Repeated rows come out as often as they go in.  Null
    ids keep their row, and a component with no other id has a null ``component_id``.  An empty table gives no rows; other
    columns are not looked at.
    """
    marked = kept(docs.select(F.col(id).alias(id), fingerprint(F.col(text), words).alias("fp")), "fingerprints")
    return marked.join(fingerprint_components(marked, id, radius).select("fp", "component_id"), "fp").select(id, "fp", "component_id")


def fingerprint_components(marked: DataFrame, id: str, radius: int) -> DataFrame:
    """One row a distinct ``fp``: ``component_id``, and ``keeper``, the fingerprint of the component's smallest id."""
    nodes = kept(marked.groupBy("fp").agg(F.min(id).alias("least")), "nodes")
    roots = components(near_edges(nodes.select("fp"), radius)).select(F.col("node").alias("fp"), "root")
    joined = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    first = F.min(F.struct(F.col("least").isNull(), "least", "fp"))
    best = joined.groupBy("root").agg(first.alias("s")).select("root", F.col("s.least").alias("component_id"), F.col("s.fp").alias("keeper"))
    return joined.join(best, "root").select("fp", "component_id", "keeper")


def one_of_each_group(docs: DataFrame, id: str = "doc_id", text: str = "text", words: int = 3, radius: int = 3) -> DataFrame:
    """``docs`` with one row of every near-duplicate component: that of its smallest id, all columns as they were.

    Nulls and repeats as in ``near_duplicates``; of repeated rows of the smallest id one stays.  A component of null ids only
    keeps one row.
    """
    marked = docs.select(F.struct("*").alias("row"), F.col(id).alias("id"), fingerprint(F.col(text), words).alias("fp"))
    groups = fingerprint_components(kept(marked.select("id", "fp"), "fingerprints"), "id", radius).where("fp = keeper")
    stays = marked.join(groups, "fp").where(F.col("id").eqNullSafe(F.col("component_id")))
    return stays.dropDuplicates(["fp"]).select("row.*")


def hex64(c: Column) -> Column:
    return F.lower(F.lpad(F.hex(c), 16, "0"))
