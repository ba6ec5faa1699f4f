"""Benchmark passages in documents within an edit distance: pigeonhole pieces, then Myers' bit-parallel verification."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

#: Edits allowed for each code point of an item.
ERRORS = 0.05
#: A block of test items holds so many items and code points at most (one longer item is a block of its own).
BLOCK_ITEMS, BLOCK_CHARS = 2000, 2_000_000
LOWER_ASCII = {c: c + 32 for c in range(65, 91)}
MATCH = ArrayType(StructType([StructField("item_id", LongType()), StructField("distance", IntegerType()), StructField("start", LongType()), StructField("end", LongType())]))


@dataclass(frozen=True)
class Item:
    id: int | None
    text: str
    budget: int


def item_of(id: int | None, text: str, errors: float) -> Item:
    return Item(id, text.translate(LOWER_ASCII), int(len(text) * errors))


def pieces_of(item: Item) -> list[tuple[int, str]]:
    """The item cut into budget + 1 pieces of nearly equal length, each with its place: edits can't spoil all of them."""
    n = item.budget + 1
    at = [round(i * len(item.text) / n) for i in range(n + 1)]
    return [(a, item.text[a:b]) for a, b in zip(at, at[1:], strict=False)]


def letter_masks(pattern: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


def myers(pattern: str, text: str, masks: dict[str, int] | None = None) -> tuple[int, int]:
    """Least edit distance of ``pattern`` to any stretch of ``text``, and the end of the first stretch that has it.

    Column differences of the distance matrix are kept as two bit vectors as long as the pattern; an integer holds any length.
    """
    m = len(pattern)
    masks = letter_masks(pattern) if masks is None else masks
    every, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score = every, 0, m
    best, end = m, 0
    for j, c in enumerate(text, 1):
        eq = masks.get(c, 0)
        cross = (((eq & up) + up) ^ up) | eq | down
        plus = down | ~(cross | up) & every
        minus = up & cross
        score += bool(plus & top) - bool(minus & top)
        plus = plus << 1 & every
        minus = minus << 1 & every
        along = eq | down
        up = minus | ~(along | plus) & every
        down = plus & along
        if score < best:
            best, end = score, j
    return best, end


class Finder:
    """All pieces of a block of items in one automaton."""

    def __init__(self, items: list[Item]):
        self.items = items
        self.masks: dict[int, dict[str, int]] = {}
        places: dict[str, list[tuple[int, int]]] = {}
        for i, item in enumerate(items):
            for at, piece in pieces_of(item):
                if piece:
                    places.setdefault(piece, []).append((i, at))
        self.automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), where))
        if places:
            self.automaton.make_automaton()

    def windows(self, text: str) -> dict[int, list[list[int]]]:
        """By item, the merged stretches of ``text`` that a piece's hit allows the item to lie in."""
        out: dict[int, list[list[int]]] = {}
        for last, (size, where) in self.automaton.iter(text):
            for i, at in where:
                begin = last + 1 - size - at
                item = self.items[i]
                lo, hi = max(0, begin - item.budget), min(len(text), begin + len(item.text) + item.budget)
                mine = out.setdefault(i, [])
                if mine and lo <= mine[-1][1]:
                    mine[-1][0], mine[-1][1] = min(lo, mine[-1][0]), max(hi, mine[-1][1])
                else:
                    mine.append([lo, hi])
        return out

    def find(self, text: str | None) -> list[tuple[int | None, int, int, int]]:
        """``(item id, distance, start, end)`` of every item within its budget: its best stretch, the first of equals."""
        if not text or not len(self.automaton):
            return []
        text = text.translate(LOWER_ASCII)
        out = []
        for i, stretches in sorted(self.windows(text).items()):
            item = self.items[i]
            masks = self.masks.setdefault(i, letter_masks(item.text))
            best: tuple[int, int] | None = None
            for lo, hi in stretches:
                distance, end = myers(item.text, text[lo:hi], masks)
                if distance <= item.budget and (best is None or (distance, lo + end) < best):
                    best = (distance, lo + end)
            if best:
                distance, end = best
                back = text[max(0, end - len(item.text) - item.budget) : end][::-1]
                _, size = myers(item.text[::-1], back)
                out.append((item.id, distance, end - size, end))
        return out


def blocks_of(benchmark: DataFrame, id: str, text: str, errors: float) -> Iterator[list[Item]]:
    """Test items in blocks of bounded size, read from the table one partition at a time.  Null and empty texts are no items."""
    block: list[Item] = []
    size = 0
    for row in benchmark.select(F.col(id).cast("long"), F.col(text)).where(F.length(text) > 0).toLocalIterator():
        if block and (len(block) >= BLOCK_ITEMS or size + len(row[1]) > BLOCK_CHARS):
            yield block
            block, size = [], 0
        block.append(item_of(row[0], row[1], errors))
        size += len(row[1])
    if block:
        yield block


def matches_column(block: list[Item], text: Column) -> Column:
    """The matches of a block's items in a text, as an array; a task builds the automaton once."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        finder = Finder(block)
        for texts in batches:
            yield pd.Series([finder.find(t) for t in texts], dtype="object")

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, MATCH)(text)


def leaks(docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", errors: float = ERRORS) -> DataFrame:
    """One row a document and test item that stands in it: id, ``item_id``, ``distance``, ``start``, ``end`` (code points, end exclusive).

    An item may differ by floor(``errors`` x its length) edits, letters A-Z counting as a-z.  The whole text is searched against every
    item, block by block; only a block of bounded size is in memory or sent to tasks.  Null and empty texts match nothing;
    items too short for an edit must stand exactly; repeated documents and items give repeated rows; without items
    there are no rows; other columns are not read.
    """
    out = None
    for block in blocks_of(benchmark, item, item_text, errors):
        found = docs.select(F.col(id).alias(id), F.explode(matches_column(block, F.col(text))).alias("_m")).select(id, "_m.*")
        out = found if out is None else out.unionByName(found)
    return docs.select(F.col(id).alias(id), F.explode(F.array().cast(MATCH)).alias("_m")).select(id, "_m.*") if out is None else out


def without_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", errors: float = ERRORS) -> DataFrame:
    """``docs`` without the rows that a test item stands in, as ``leaks`` finds them."""
    for block in blocks_of(benchmark, item, item_text, errors):
        docs = docs.where(F.size(matches_column(block, F.col(text))) == 0)
    return docs
