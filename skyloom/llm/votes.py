"""SimHash fingerprints by DataFrame expressions alone, and their search by permuted block tables."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyloom.llm.common import LOWER, UPPER, kept

BITS = 64
LANES = 32
LANE = 0x0000000100000001
GAPS = r"[\x20\x09-\x0D]+"


def words_of(text: Column) -> Column:
    """The words of a text between ASCII white space."""
    return F.filter(F.split(text, GAPS), lambda w: w != "")


def vote_columns(h: Column, weight: Column) -> list[Column]:
    """Sums of ``weight`` where each bit of ``h`` is one: 32 longs of two 32-bit counters (bits i and i + 32)."""
    return [F.sum(F.shiftrightunsigned(h, i).bitwiseAND(F.lit(LANE)) * weight).alias(f"v{i}") for i in range(LANES)]


def signed_bits(total: Column) -> Column:
    """The fingerprint of ``vote_columns``: a bit is one where its weight is over half of ``total``."""
    low = [F.when(F.col(f"v{i}").bitwiseAND(F.lit(0xFFFFFFFF)) * 2 > total, F.lit(1 << i)).otherwise(F.lit(0).cast("long")) for i in range(LANES)]
    high = [F.when(F.shiftrightunsigned(f"v{i}", 32) * 2 > total, F.lit((1 << (i + 32)) if i < 31 else -(1 << 63))).otherwise(F.lit(0).cast("long")) for i in range(LANES)]
    out = low[0]
    for c in [*low[1:], *high]:
        out = out.bitwiseOR(c)
    return out


def fingerprints(texts: DataFrame, keys: list[str], text: str, words: int = 5) -> DataFrame:
    """``keys``, ``fp`` and ``copies`` of every different set of keys: the signed votes of a text's weighted term hashes.

    Terms are shingles of ``words`` ASCII-lower-cased words (a shorter text is one term), hashed by chained XXH64 over their words;
    every occurrence votes with the capped number of its words' letters as weight, so long words count for more than particles.  A
    text's terms are exploded and summed inside one task, 32 packed sums a row, before anything is shuffled; the
    shuffle has one row a text and task.  Equal keys must mean equal texts; ``copies`` says how many rows had them.  Null
    and empty texts have fingerprint nought.  Counters hold total weights up to 2^31: texts of a hundred million words.
    """
    w = F.col("_w")
    rows = texts.select(*keys, words_of(F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER)).alias("_w"))
    rows = rows.select(*keys, "_w", F.explode(F.sequence(F.lit(0), F.greatest(F.size(w) - words, F.lit(0)))).alias("_i"))
    terms = [F.get(w, F.col("_i") + j) for j in range(words)]
    length = F.least(sum((F.coalesce(F.length(t), F.lit(0)) for t in terms[1:]), F.coalesce(F.length(terms[0]), F.lit(0))), F.lit(4 * words))
    rows = rows.select(*keys, F.xxhash64(*terms).alias("_h"), length.cast("long").alias("_weight"), F.when(F.col("_i") == 0, 1).otherwise(0).alias("_first"))
    sums = rows.groupBy(*keys).agg(F.sum("_weight").alias("_total"), F.sum("_first").alias("copies"), *vote_columns(F.col("_h"), F.col("_weight")))
    return sums.select(*keys, signed_bits(F.col("_total")).alias("fp"), "copies")


def hex64(c: Column) -> Column:
    return F.lower(F.lpad(F.hex(c), 16, "0"))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bits, 0 to 1."""
    return 1 - F.bit_count(a.bitwiseXOR(b)) / F.lit(float(BITS))


def block_tables(radius: int, blocks: int | None = None) -> list[int]:
    """Masks of the permuted tables: ``blocks`` (radius + 2 if none is given) runs of bits, every choice of blocks - radius of them.

    Fingerprints that differ in ``radius`` bits spoil at most ``radius`` blocks, so they agree on all of some choice.
    """
    n = blocks or radius + 2
    edges = [round(i * BITS / n) for i in range(n + 1)]
    runs = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    masks = [sum(c) for c in combinations(runs, n - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def search(queries: DataFrame, corpus: DataFrame, radius: int = 3, blocks: int | None = None) -> DataFrame:
    """``(query_fp, fp, distance)``: every fingerprint of ``corpus`` within ``radius`` bits of one of ``queries``.

    Both hold distinct values ``fp``; ids are joined by the caller, so copies are never paired.  Each table is one kind of key in an
    equi-join; a pair found in several tables is kept from its first one, without a further shuffle.
    """
    masks = block_tables(radius, blocks)
    table = F.explode(F.array(*[F.struct(F.lit(i).alias("t"), F.lit(m).alias("m")) for i, m in enumerate(masks)]))

    def keyed(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.col("fp").alias(name), table.alias("_t")).select(name, F.col("_t.t").alias("_t"), F.col(name).bitwiseAND(F.col("_t.m")).alias("_k"))

    pairs = keyed(queries, "query_fp").join(keyed(corpus, "fp"), ["_t", "_k"])
    differ = F.col("query_fp").bitwiseXOR(F.col("fp"))
    earlier = F.lit(False)
    for i, m in enumerate(masks[:-1]):
        earlier = earlier | ((F.col("_t") > i) & (differ.bitwiseAND(F.lit(m)) == 0))
    return pairs.where((F.bit_count(differ) <= radius) & ~earlier).select("query_fp", "fp", F.bit_count(differ).alias("distance"))


def next_of(docs: DataFrame, id: str, text: str) -> DataFrame:
    """``(id, next_id, need)`` of every different id: the next larger one (the first after the last) and the most code points asked of it.

    Only ids are shuffled.  The order is cut into ranges; a range's last id takes the first of the next range that has one, from a
    table of one row a range.
    """
    ids = docs.where(F.col(id).isNotNull()).groupBy(F.col(id).alias("id")).agg(F.max(F.floor(F.char_length(text) / 4)).alias("need"))
    ids = kept(ids.repartitionByRange("id").select("id", "need", F.spark_partition_id().alias("part")), "ids")
    firsts = ids.groupBy("part").agg(F.min("id").alias("first"))
    start = firsts.agg(F.min("first").alias("start"))
    after = firsts.select(F.col("part").alias("p"), F.lead("first").over(Window.orderBy("part")).alias("after"))
    inside = Window.partitionBy("part").orderBy("id")
    rows = ids.withColumn("following", F.lead("id").over(inside)).join(F.broadcast(after), F.col("part") == F.col("p")).crossJoin(start)
    return rows.select("id", F.coalesce("following", "after", "start").alias("next_id"), "need")


def _marked(rows: DataFrame, words: int) -> DataFrame:
    """Both fingerprints of every different ``id``, ``text`` and ``head`` (what its tail is replaced by), and how often it was met."""
    tail = "int(floor(char_length(text) / 4))"
    edited = F.expr(f"concat(left(text, char_length(text) - {tail}), coalesce(left(head, {tail}), ''))")
    kinds = F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("t")), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("t")))
    keys = ["id", "n_chars", "edited_sha256", "sha"]
    both = rows.withColumn("edited", edited).select(
        "id", F.char_length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), F.sha2("text", 256).alias("sha"), F.explode(kinds).alias("_p")
    )
    found = fingerprints(both.select(*keys, "_p.kind", "_p.t"), [*keys, "kind"], "t", words)
    side = lambda k: F.max(F.when(F.col("kind") == k, F.col("fp")))
    return found.groupBy(*keys).agg(side(0).alias("fp"), side(1).alias("edited_fp"), F.max("copies").alias("copies"))


def near_counts(marked: DataFrame, asked: Column, radius: int = 3) -> DataFrame:
    """``(fp, near_docs)`` for the fingerprints of rows that ``asked`` holds for: how many documents lie within ``radius`` bits.

    ``marked`` has ``fp`` and ``copies``.  Different fingerprints meet in the block tables; how many documents have each is joined after that.
    """
    sizes = kept(marked.groupBy("fp").agg(F.sum("copies").alias("docs")), "sizes")
    queries = marked.where(asked).select("fp").distinct()
    found = search(queries, sizes.select("fp"), radius).join(sizes, "fp")
    return found.groupBy(F.col("query_fp").alias("fp")).agg(F.sum("docs").alias("near_docs"))


def edited_fingerprints(docs: DataFrame, id: str = "doc_id", text: str = "text", words: int = 5, asked: Column | None = None, radius: int = 3) -> DataFrame:
    """Fingerprints of every text and of its edited text, with likenesses.

    The edited text has its last floor(n/4) code points replaced by the first as many (or all) of the next document, by ascending
    id, the first after the last.  Null texts are empty.  Repeated ids are one place in the order: its text is the one of smallest
    SHA-256.  A null id has no next document: nothing replaces its tail, and ``near_next`` is null.  Repeated rows come out as
    often as they went in.  Columns: id, ``n_chars``, ``edited_sha256``, ``fp``, ``edited_fp``, ``near_edited``, ``near_next``, and
    ``near_docs``: for rows that ``asked`` (of ``id``) holds for, how many documents' fingerprints lie within ``radius`` bits of theirs,
    their own included; null for the others.
    """
    rows = docs.select(F.col(id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    order = kept(next_of(rows, "id", "text"), "order")
    wanted = order.select(F.col("id").alias("before"), F.col("next_id").alias("id"), "need")
    placed = rows.where("id is not null")  # the same exchange of texts serves both joins
    heads = placed.join(wanted, "id").select("before", F.struct(F.sha2("text", 256).alias("sha"), F.expr("left(text, int(need))").alias("head")).alias("s"))
    heads = heads.groupBy("before").agg(F.min("s").alias("s")).select(F.col("before").alias("id"), F.col("s.head").alias("head"))
    unplaced = rows.where("id is null").withColumn("head", F.lit(None).cast("string"))
    # either side is marked on its own: the join's partitioning then serves the sums of votes
    marked = kept(_marked(placed.join(heads, "id", "left"), words).unionByName(_marked(unplaced, words)), "marked")
    of_id = marked.where("id is not null").groupBy("id").agg(F.min(F.struct("sha", "fp")).alias("s"))
    nexts = order.join(of_id.select(F.col("id").alias("next_id"), F.col("s.fp").alias("next_fp")), "next_id").select("id", "next_fp")
    asked = F.lit(False) if asked is None else F.coalesce(asked, F.lit(False))
    near = near_counts(marked, asked, radius)
    out = marked.join(nexts, "id", "left").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    out = out.where(asked).join(near, "fp").unionByName(out.where(~asked).withColumn("near_docs", F.lit(None).cast("long")))
    return out.select(
        F.col("id").alias(id), "n_chars", "edited_sha256", "fp", "edited_fp", "near_docs",
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )
