"""Repeated lines over all documents: ranges of hashes, streamed by document and position, give a compressed bitmap a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyloom.llm.common import kept, lower_ascii

#: Least code points of a key, and documents that make one repeated.
LEAST, DOCUMENTS = 20, 3
SPACE = " \t\n\x0b\x0c\r"
#: A hash of over 1 / HOT of all lines is dealt over SALTS ranges; TRACKED numbers find all such hashes.
HOT, SALTS, TRACKED = 1000, 256, 20_000


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """A line without white space at its ends, A-Z as a-z."""
    return lower_ascii(F.btrim(line, F.lit(SPACE)))


def _rows(docs: DataFrame, id: str, text: str) -> DataFrame:
    # a row is known by id and text: equal rows share their bitmap
    return docs.select(F.col(id).alias("doc"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("mark"), F.col(text).alias("text"))


def bitmaps(docs: DataFrame, id: str = "doc_id", text: str = "text", least: int = LEAST, documents: int = DOCUMENTS) -> DataFrame:
    """``doc, mark, dropped`` for every document that loses lines: a run-length bitmap, ``dropped`` its sorted stretches
    ``(first, last)`` of line numbers from 0 (all other lines are kept), ``mark`` the XXH64 of its text.

    Lines go as two 64-bit hashes of their key.  They are dealt by ranges of the hashes and sorted inside them by document,
    largest first, and position; one stream over that order meets each key's largest document first and counts its documents.  A
    hash of a great share of all lines, found by a sketch of bounded size, is split over ``SALTS`` ranges; how many documents
    these have together and which is the largest is one row a hash, at most ``HOT`` in all.  Texts don't move.
    """
    lines = _rows(docs, id, text).select("doc", "mark", F.posexplode(lines_of(F.col("text"))).alias("pos", "line")).withColumn("key", line_key(F.col("line")))
    lines = lines.where(F.char_length("key") >= least).select("doc", "mark", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2"))
    lines = kept(lines, "lines")
    total, top = lines.agg(F.count("*"), F.expr(f"approx_top_k(h1, {HOT}, {TRACKED})")).first()
    hot = F.col("h1").isin([t["item"] for t in top or [] if t["count"] * HOT > total])

    dealt = lines.withColumn("salt", F.when(hot, F.pmod(F.xxhash64("doc", "mark", "pos"), F.lit(SALTS))).otherwise(F.lit(0).cast("long")))
    dealt = dealt.repartitionByRange("h1", "h2", "salt")
    group = Window.partitionBy("h1", "h2", "salt")
    down = F.col("doc").desc_nulls_last()
    seen = dealt.withColumn("largest", F.first("doc").over(group.orderBy(down, "pos"))).withColumn("n", F.dense_rank().over(group.orderBy(down)))
    seen = seen.withColumn("n", F.max("n").over(group))
    none = F.max(F.col("doc").isNull().cast("long"))
    whole = lines.where(hot).groupBy("h1", "h2").agg(F.max("doc").alias("hot_largest"), (F.count_distinct("doc") + none).alias("hot_n"))
    seen = seen.join(F.broadcast(whole), ["h1", "h2"], "left")
    is_hot = F.col("hot_n").isNotNull()
    n, largest = F.coalesce("hot_n", "n"), F.when(is_hot, F.col("hot_largest")).otherwise(F.col("largest"))
    gone = seen.where((n >= documents) & ~F.col("doc").eqNullSafe(largest))

    places = gone.groupBy("doc", "mark").agg(F.array_sort(F.collect_set("pos")).alias("p"))
    firsts = F.filter("p", lambda x, i: (i == 0) | (x - F.get("p", i - 1) > 1))
    lasts = F.filter("p", lambda x, i: (i == F.size("p") - 1) | (F.get("p", i + 1) - x > 1))
    return places.select("doc", "mark", F.zip_with(firsts, lasts, lambda a, b: F.struct(a.alias("first"), b.alias("last"))).alias("dropped"))


def without(lines: Column, dropped: Column) -> Column:
    """The lines outside of a bitmap's stretches, joined again."""
    begin = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(dropped, i - 1)["last"] + 1)
    end = lambda i: F.coalesce(F.get(dropped, i)["first"], F.size(lines))
    pieces = F.transform(F.sequence(F.lit(0), F.size(dropped)), lambda i: F.slice(lines, begin(i) + 1, end(i) - begin(i)))
    return F.array_join(F.flatten(pieces), "\n")


def drop_repeated(docs: DataFrame, id: str = "doc_id", text: str = "text", least: int = LEAST, documents: int = DOCUMENTS) -> DataFrame:
    """One row a document: id, ``n_lines``, ``n_dropped``, ``dropped`` (its bitmap's stretches) and ``kept_text``.

    A text is cut at line feeds; a null or empty one is one empty line.  Keys of at least ``least`` code points in at
    least ``documents`` documents lose all their lines outside of the largest id that holds them, which keeps all of its own.  Rows of
    one id are one document, null ids together are one below all others; repeated rows get the same result each.  An
    empty table gives no rows; other columns are not read.
    """
    rows = _rows(docs, id, text)
    found = bitmaps(docs, id, text, least, documents).withColumnsRenamed({"doc": "d", "mark": "m"})
    both = rows.join(found, F.col("doc").eqNullSafe(F.col("d")) & (F.col("mark") == F.col("m")), "left")
    lines = lines_of(F.col("text"))
    lost = F.coalesce(F.aggregate("dropped", F.lit(0), lambda s, r: s + r["last"] - r["first"] + 1), F.lit(0))
    stays = F.when(F.col("dropped").isNull(), F.coalesce("text", F.lit(""))).otherwise(without(lines, F.col("dropped")))
    return both.select(F.col("doc").alias(id), F.size(lines).cast("long").alias("n_lines"), lost.cast("long").alias("n_dropped"), "dropped", stays.alias("kept_text"))
