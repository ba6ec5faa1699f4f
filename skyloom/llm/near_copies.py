"""Near copies by exact likeness of word shingles: SimHash fingerprints link most of them, prefixes find the candidates still apart, leaders and bit
counts cut these down, whole sets judge all."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from skyloom.llm.common import components, kept
from skyloom.llm.simhash_cover import near_edges, vote

WORDS = 5
#: Likeness of two sets from which they are near, as a fraction: common over all shingles.
NEAR = (4, 5)
SEED = 42
LOWERED = bytes(range(256)).lower()
#: Cells that count the shingles of the whole table, and blocks they travel in.
CELLS, BLOCKS = 1 << 22, 64
#: Shingles that a task gathers before it counts them; nodes whose prefixes it remembers to have sent.
COUNTED, SENT = 1 << 19, 1 << 17
#: Members of a bucket that all others are held against first; rounds of this, each with ``MORE`` times as many for those still apart.
LEADERS, ROUNDS, MORE = 4, 2, 8
#: Rows that a Python worker takes at once: texts, and pairs of them.
TOGETHER = 500
#: Bits that tell the parity of the shingles in each of as many classes.
BITS = 1024
#: Bits that the fingerprints of candidates may differ in; candidates further apart come from prefixes.
RADIUS = 3
#: Bytes of a text that are hashed together.
SPAN = 1 << 17
BASE = 0xD6E8FEB86659FD93


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    done = 1
    while done < n:
        out[done : 2 * done] = out[: min(done, n - done)] * np.uint64(pow(base, done, 1 << 64))
        done *= 2
    return out


UP, DOWN = _powers(BASE, SPAN), _powers(pow(BASE, -1, 1 << 64), SPAN)
LETTER = np.frombuffer(b"".join(xxhash.xxh64_digest(bytes([c]), SEED) for c in range(256)), ">u8").astype(np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """The different shingle hashes of a text, ascending: ``words`` words, ASCII letters lower-cased; fewer words are one shingle.

    A shingle's bytes are hashed as a polynomial: differences of running sums give those of all places at once.
    """
    tokens = (text or "").encode("utf-8", "surrogatepass").translate(LOWERED).split()
    if not tokens:
        return np.zeros(0, np.uint64)
    words = min(words, len(tokens))
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
    joined = np.frombuffer(b" ".join(tokens), np.uint8)
    last = np.cumsum(sizes + 1) - 1
    first = np.concatenate([[0], last[:-1] + 1])
    first, last = first[: len(tokens) - words + 1], last[words - 1 :]
    if int((last - first).max()) > SPAN // 2:  # words of very many letters
        return np.unique(np.array([xxhash.xxh64_intdigest(joined[a:b].tobytes(), SEED) for a, b in zip(first.tolist(), last.tolist(), strict=True)], np.uint64))
    parts, i = [], 0
    while i < len(first):
        begin = int(first[i])
        j = int(np.searchsorted(last, begin + SPAN - 1, "right"))
        letters = joined[begin : int(last[j - 1])]
        sums = np.zeros(len(letters) + 1, np.uint64)
        np.cumsum(LETTER[letters] * UP[: len(letters)], out=sums[1:])
        a, b = first[i:j] - begin, last[i:j] - begin
        parts.append(mixed((sums[b] - sums[a]) * DOWN[a] + (b - a).astype(np.uint64)))
        i = j
    return np.unique(np.concatenate(parts))


def node_of(shingles: np.ndarray) -> int:
    """One number for equal sets."""
    return int(np.uint64(xxhash.xxh64_intdigest(shingles.astype("<u8").tobytes(), SEED)).astype(np.int64))


def prefix_size(n: int) -> int:
    """Of two near sets, each one's first so many shingles in any common order have one in common."""
    return n - -(-NEAR[0] * n // NEAR[1]) + 1


def likely(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * NEAR[1] >= NEAR[0] * (len(a) + len(b) - both)


def parities(shingles: np.ndarray) -> list[int]:
    """``BITS`` bits as signed 64-bit numbers.  Every shingle that only one of two sets has turns one bit, so bits that differ are no more than those."""
    odd = np.bincount((shingles % np.uint64(BITS)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view("<i8").tolist()


def _marked(words: int, cells: int):
    size = cells // BLOCKS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "key", "node", "fp", "block", "counts"]
        counts, parts, waiting, kinds = np.zeros(cells, np.uint32), [], 0, None

        def count() -> None:
            counts[:] += np.bincount((np.concatenate(parts) % np.uint64(cells)).astype(np.int64), minlength=cells).astype(np.uint32)
            parts.clear()

        for batch in batches:
            ids, keys, nodes, fps = batch.column("id"), batch.column("key"), [], []
            kinds = ids.type, keys.type
            for text in batch.column("text"):
                s = shingle_set(text.as_py(), words)
                nodes.append(node_of(s))
                fps.append(vote(s))
                parts.append(s)
                waiting += len(s)
                if waiting >= COUNTED:
                    count()
                    waiting = 0
            n = len(nodes)
            yield pa.RecordBatch.from_arrays([ids, keys, pa.array(nodes, pa.int64()), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names)
        if kinds:
            if parts:
                count()
            told = [zlib.compress(counts[i * size : (i + 1) * size].astype("<u4").tobytes(), 1) for i in range(BLOCKS)]
            none = [pa.nulls(BLOCKS, kinds[0]), pa.nulls(BLOCKS, kinds[1]), pa.nulls(BLOCKS, pa.int64()), pa.nulls(BLOCKS, pa.int64())]
            yield pa.RecordBatch.from_arrays([*none, pa.array(range(BLOCKS), pa.int32()), pa.array(told, pa.binary())], names)

    return run


def _summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, counts in zip(batch["block"], batch["counts"], strict=True):
            own = np.frombuffer(zlib.decompress(counts), "<u4").astype(np.uint64)
            total[block] = total.get(block, 0) + own
    # quarters of powers of two are enough to tell frequent from rare, in a byte
    ranks = {b: np.floor(4 * np.log2(np.maximum(t, 1))).astype(np.uint8).tobytes() for b, t in total.items()}
    yield pd.DataFrame({"block": np.array(list(ranks), np.int32), "ranks": list(ranks.values())})


INDEX = "token long, node long, size int, at int, bits array<long>"


def _prefixes(words: int, ranks):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rank = np.frombuffer(ranks.value, np.uint8)
        sent: set[int] = set()
        for whole in batches:
            for begin in range(0, len(whole), TOGETHER):
                tokens, nodes, sizes, bits = [], [], [], []
                for text in whole["text"].iloc[begin : begin + TOGETHER]:
                    s = shingle_set(text, words)
                    if not len(s) or (node := node_of(s)) in sent:
                        continue
                    if len(sent) >= SENT:
                        sent.clear()
                    sent.add(node)
                    order = np.lexsort((s, rank[(s % np.uint64(len(rank))).astype(np.int64)]))
                    tokens.append(s[order[: prefix_size(len(s))]].view(np.int64))
                    nodes.append(node)
                    sizes.append(len(s))
                    bits.append(parities(s))
                n = [len(t) for t in tokens]
                first = np.zeros(sum(n), object)
                first[:] = None
                for i, b in zip(np.cumsum([0, *n])[:-1], bits, strict=False):
                    first[i] = b
                yield pd.DataFrame({
                    "token": np.concatenate([*tokens, np.zeros(0, np.int64)]),
                    "node": np.repeat(np.array(nodes, np.int64), n),
                    "size": np.repeat(np.array(sizes, np.int32), n),
                    "at": np.concatenate([*[np.arange(k, dtype=np.int32) for k in n], np.zeros(0, np.int32)]),
                    "bits": first,
                })

    return run


def _judged(words: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            near = [likely(shingle_set(x, words), shingle_set(y, words)) for x, y in zip(batch["ta"], batch["tb"], strict=True)]
            yield batch.loc[near, ["a", "b"]]

    return run


def _alike(a: str, b: str) -> str:
    """SQL of what the sizes of two near sets fulfil."""
    p, q = NEAR
    return f"{p} * greatest({a}.size, {b}.size) <= {q} * least({a}.size, {b}.size)"


def _fits(a: str, b: str) -> str:
    """SQL of what two near sets fulfil at their first common shingle: sizes, and places that leave enough in common."""
    p, q = NEAR
    return f"{_alike(a, b)} and {p + q} * least({a}.size - {a}.at, {b}.size - {b}.at) >= {p} * ({a}.size + {b}.size)"


def _few_bits(a: str, b: str) -> str:
    """SQL of what near sets fulfil: shingles of only one of them are a ninth of both sizes at most, and so are differing bits."""
    p, q = NEAR
    differ = " + ".join(f"bit_count({a}.bits[{i}] ^ {b}.bits[{i}])" for i in range(BITS // 64))
    return f"{p + q} * ({differ}) <= {q - p} * ({a}.size + {b}.size)"


def fingerprint_pairs(nodes: DataFrame) -> DataFrame:
    """Pairs ``a, b`` of ``nodes`` (``node``, ``fp``) whose chains connect all with fingerprints within ``RADIUS`` bits; equal ones are one fingerprint."""
    first = kept(nodes.groupBy("fp").agg(F.min("node").alias("head")), "fingerprints")
    equal = nodes.join(first, "fp").where("node != head").select(F.col("node").alias("x"), F.col("head").alias("y"))
    x, y = (first.select(F.col("fp").alias(f), F.col("head").alias(n)) for f, n in (("a", "x"), ("b", "y")))
    near = near_edges(first.select("fp"), RADIUS).join(x, "a").join(y, "b").select("x", "y")
    return equal.unionByName(near).select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()


def groups(rows: DataFrame, words: int = WORDS, cells: int = CELLS, leaders: int = LEADERS) -> DataFrame:
    """Of ``rows`` with ``id`` and ``text``: ``key`` (of the text) and ``least`` of every group's document of the smallest id.

    Texts of equal shingle sets are one node; nodes of likeness 4/5 or more are linked, and chains of links are a group.  SimHash
    fingerprints of the sets within ``RADIUS`` bits, met through covering masks, are the first candidates; those of other groups
    that this leaves come from prefixes, so that no link is lost: any two near sets share a shingle among each one's first fifth in a common order.  That order goes by how often the whole
    table has a shingle, told by ``cells`` counters of constant size, so passages that many documents share come last.  Nodes that share
    one of these are a bucket.  Its first ``leaders`` members, in one order of all nodes, meet all others: a few rows a member.
    Only buckets that this leaves in several groups go on, and there only members outside of the bucket's largest group: in another round they
    meet more and other leaders, then all members of other groups, by equi-joins that keep pairs whose parity bits allow
    them to be near.  Whole sets decide, one pair at a time.
    Everything runs here, in batches of ``TOGETHER`` rows.
    """
    conf, name = rows.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(name)
    conf.set(name, str(TOGETHER))
    try:
        return _groups(rows, words, cells, leaders)
    finally:
        conf.set(name, before)


def _groups(rows: DataFrame, words: int, cells: int, leaders: int) -> DataFrame:
    rows = rows.withColumn("key", text_key(F.col("text")))
    spark = rows.sparkSession
    told = StructType([rows.schema["id"]]).add("key", "binary").add("node", "long").add("fp", "long").add("block", "integer").add("counts", "binary")
    told["id"].nullable = True
    told = kept(rows.select("id", "key", "text").mapInArrow(_marked(words, cells), told), "marked")
    nodes = told.where("block is null").groupBy("node").agg(F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("least"), "key")).alias("first"), F.min("fp").alias("fp"))
    nodes = kept(nodes, "nodes")
    summed = told.where("block is not null").select("block", "counts").repartition(BLOCKS, "block").mapInPandas(_summed, "block int, ranks binary")
    ranks = dict(summed.toPandas().itertuples(index=False))  # one byte a cell
    ranks = spark.sparkContext.broadcast(b"".join(ranks.get(b, bytes(cells // BLOCKS)) for b in range(BLOCKS)))

    index = kept(rows.select("text").mapInPandas(_prefixes(words, ranks), INDEX), "index")
    several = index.groupBy("token").agg(F.count("*").alias("k")).where("k > 1").select("token")
    live = kept(index.drop("bits").join(several, "token", "left_semi").dropDuplicates(["token", "node"]), "live")
    order = Window.partitionBy("token").orderBy(F.xxhash64("node"), "node")
    heads = kept(live.withColumn("place", F.row_number().over(order)).where(F.col("place") <= leaders), "leaders")

    known = nodes.select("node", "first.key")
    bits = index.where("bits is not null").select("node", "size", "bits").dropDuplicates(["node"])

    def judged(pairs: DataFrame) -> DataFrame:
        """The near ones of different pairs ``a, b``."""
        asked = kept(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "asked")
        mine = kept(bits.join(asked, "node", "left_semi"), "bits")
        x, y = (mine.select(F.col("node").alias(n), F.struct("size", "bits").alias(v)) for n, v in (("a", "x"), ("b", "y")))
        pairs = kept(pairs.join(x, "a").join(y, "b").where(_few_bits("x", "y")).select("a", "b"), "pairs")
        asked = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(known, "node")
        own = kept(rows.select("key", "text").join(asked, "key").dropDuplicates(["node"]).select("node", "text"), "texts")
        both = pairs.join(own.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a").join(own.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")
        return kept(both.mapInPandas(_judged(words), "a long, b long"), "links")

    links = judged(kept(fingerprint_pairs(nodes.select("node", "fp")), "pairs"))
    roots = components(links)
    of = lambda n: roots.select(F.col("node").alias(n), F.col("root").alias(f"of_{n}"))

    # a leader that leads in this bucket may not lead in that of the first common shingle, so places aren't asked for here
    ends = [F.greatest("x.node", "y.node").alias("a"), F.least("x.node", "y.node").alias("b")]
    after = "(xxhash64(x.node), x.node) > (xxhash64(y.node), y.node)"
    stars = kept(live.alias("x").join(heads.alias("y"), "token").where(after).where(_alike("x", "y")).select(*ends).distinct(), "pairs")
    new = stars.join(of("a"), "a", "left").join(of("b"), "b", "left").where("coalesce(of_a, a) != coalesce(of_b, b)").select("a", "b")
    links = kept(links.unionByName(judged(new)), "links")
    roots = components(links)

    def apart(least: int) -> DataFrame:
        """Rows of the buckets of over ``least`` members that lie in several groups, with the group ``most`` of them are in."""
        wide = live.groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") > least).select("token")
        some = live.join(wide, "token", "left_semi").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        some = kept(some, "members")
        most = some.groupBy("token", "root").agg(F.count("*").alias("n")).groupBy("token").agg(F.max_by("root", F.struct("n", "root")).alias("most"), F.count("*").alias("roots"))
        return kept(some.join(most.where("roots > 1").select("token", "most"), "token").join(bits.select("node", "bits"), "node"), "mixed")

    for r in range(1, ROUNDS):
        some = apart(leaders * MORE ** (r - 1))
        if some.isEmpty():
            break
        order = Window.partitionBy("token").orderBy(F.xxhash64("node", F.lit(r)), "node")
        heads = some.withColumn("place", F.row_number().over(order)).where(F.col("place") <= leaders * MORE**r)
        pairs = some.where("root != most").alias("x").join(heads.alias("y"), "token").where("x.root != y.root").where(_alike("x", "y")).where(_few_bits("x", "y"))
        pairs = kept(pairs.select(*ends).distinct(), "pairs")
        if not pairs.isEmpty():
            links = kept(links.unionByName(judged(pairs)), "links")
            roots = components(links)

    some = apart(leaders)
    apart_still = "x.root != y.root and (y.root = y.most or x.node > y.node)"
    rest = some.where("root != most").alias("x").join(some.alias("y"), "token").where(apart_still).where(_fits("x", "y")).where(_few_bits("x", "y"))
    rest = kept(rest.select(*ends).distinct().join(stars, ["a", "b"], "left_anti"), "pairs")
    if not rest.isEmpty():
        roots = components(links.unionByName(judged(rest)))
    joined = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    return kept(joined.groupBy("root").agg(F.min("first").alias("s")).select("s.key", "s.least"), "groups")


def text_key(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def one_of_each_group(docs: DataFrame, id: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """``docs`` with one row of every group of near copies: that of its smallest id, all columns as they were.

    Null texts count as empty, and texts without words are one node.  Of repeated rows of the smallest id one stays; a group
    of null ids only keeps one row.  An empty table gives no rows.
    """
    least = groups(docs.select(F.col(id).alias("id"), F.col(text).alias("text")), words)
    rows = docs.select(F.struct("*").alias("row"), F.col(id).alias("id"), text_key(F.col(text)).alias("key"))
    stays = rows.join(least, (rows["key"] == least["key"]) & rows["id"].eqNullSafe(least["least"]), "left_semi")
    return stays.dropDuplicates(["key"]).select("row.*")
