"""Packing documents into training sequences: first-fit decreasing in randomised groups."""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import tiktoken
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY = 1024
#: Bytes of text a group is meant to hold; the number of groups follows the input.
GROUP_BYTES = 8_000_000
GPT_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PIECES = "id long, known boolean, start long, tokens binary, doc_tokens long, grp long"
PLACED = "id long, known boolean, start long, length long, tokens binary, doc_tokens long, sequence_id long, offset long"


def _byte_letters() -> dict[str, int]:
    """The printable letter of every byte in byte-level vocabularies: printable bytes are themselves, the others follow 255 in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=2)
def encoder(path: str) -> tiktoken.Encoding:
    """The byte-level BPE of a ``tokenizers`` file, run by the faster of the two libraries: same splits, merges and ids.

    In such a vocabulary a merge's rank is the order of the merged token's id, which is what is needed here; tokens the file adds
    (its special strings) keep their ids too.
    """
    with open(path, encoding="utf-8") as f:
        said = json.load(f)
    letters = _byte_letters()
    added = {t["content"]: t["id"] for t in said["added_tokens"]}
    ranks = {bytes(letters[c] for c in token): i for token, i in said["model"]["vocab"].items() if token not in added}
    return tiktoken.Encoding("byte_bpe", pat_str=GPT_SPLIT, mergeable_ranks=ranks, special_tokens=added)


class Bins:
    """Open bins under a tournament tree: each inner node holds the largest free space below it."""

    def __init__(self, most: int, capacity: int):
        self.leaves = 1 << max(0, most - 1).bit_length()
        self.tree = [capacity] * (2 * self.leaves)

    def first_fit(self, size: int) -> int:
        """The leftmost bin with room, which then has less of it."""
        tree, at = self.tree, 1
        while at < self.leaves:
            at *= 2
            if tree[at] < size:
                at += 1
        tree[at] -= size
        leaf = at
        while at > 1:
            at //= 2
            tree[at] = max(tree[2 * at], tree[2 * at + 1])
        return leaf - self.leaves


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[list[int]]:
    """Positions of ``sizes`` by bin; ties in the order given."""
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    bins, tree = [], Bins(max(len(sizes), 1), capacity)
    for i in order:
        b = tree.first_fit(sizes[i])
        if b == len(bins):
            bins.append([])
        bins[b].append(i)
    return bins


def topped_up(bins: list[list[int]], sizes: list[int], capacity: int) -> list[list[tuple[int, int, int]]]:
    """Bins of ``(item, from, length)`` without room to spare: the emptiest bins are cut up to fill the others.

    What the last one leaves is split into runs of power-of-two lengths, largest first, which need no padding.
    """
    full = [[(i, 0, sizes[i]) for i in b] for b in bins]
    used = [sum(sizes[i] for i in b) for b in bins]
    order = sorted(range(len(bins)), key=lambda b: -used[b])
    out, lo, hi = [], 0, len(order) - 1
    while lo < hi:
        room = capacity - used[order[lo]]
        while room and lo < hi:
            giver = order[hi]
            item, begin, length = full[giver].pop()
            take = min(room, length)
            full[order[lo]].append((item, begin + length - take, take))
            if take < length:
                full[giver].append((item, begin, length - take))
            used[giver] -= take
            used[order[lo]] += take
            room -= take
            if not full[giver]:
                hi -= 1
        if not room:
            out.append(full[order[lo]])
            lo += 1
    if lo == hi and full[order[lo]]:
        rest, left = full[order[lo]], used[order[lo]]
        if left == capacity:
            return [*out, rest]
        while left:
            size = 1 << (left.bit_length() - 1)
            left -= size
            part = []
            while size:
                item, begin, length = rest.pop()
                take = min(size, length)
                part.append((item, begin + length - take, take))
                if take < length:
                    rest.append((item, begin, length - take))
                size -= take
            out.append(part)
    return out


def _tokenise(path: str, end: int, capacity: int, groups: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = encoder(path)
        seen: Counter[int] = Counter()
        part = TaskContext.get().partitionId()
        for batch in batches:
            out = []
            for id, known, text in zip(batch["id"], batch["known"], batch["text"], strict=True):
                ids = np.append(bpe.encode_to_numpy(text, allowed_special="all").astype("<u4"), np.uint32(end))
                mark = xxhash.xxh64_intdigest(ids.tobytes(), seed=int(id) % (1 << 63))
                seen[mark] += 1
                for start in range(0, len(ids), capacity):
                    grp = xxhash.xxh64_intdigest(f"{mark}:{seen[mark]}:{part}:{start}".encode()) % groups
                    out.append((id, known, start, ids[start : start + capacity].astype("<u2" if bpe.n_vocab <= 1 << 16 else "<u4").tobytes(), len(ids), grp))
            yield pd.DataFrame(out, columns=["id", "known", "start", "tokens", "doc_tokens", "grp"])

    return run


def _pack(path: str, capacity: int):
    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        kind = np.dtype("<u2" if encoder(path).n_vocab <= 1 << 16 else "<u4")
        group = group.sort_values(["known", "id", "start", "doc_tokens"], kind="stable").reset_index(drop=True)
        tokens = [np.frombuffer(t, kind) for t in group["tokens"]]
        sizes = [len(t) for t in tokens]
        whole = [i for i, n in enumerate(sizes) if n == capacity]
        rest = [i for i, n in enumerate(sizes) if n < capacity]
        parts = first_fit_decreasing([sizes[i] for i in rest], capacity)
        bins = [[(i, 0, capacity)] for i in whole] + [[(rest[i], a, n) for i, a, n in b] for b in topped_up(parts, [sizes[i] for i in rest], capacity)]
        out = []
        for number, content in enumerate(bins):
            offset = 0
            for i, begin, n in content:
                out.append((i, begin, n, (int(key[0]) << 24) + number, offset))
                offset += n
        placed = pd.DataFrame(out, columns=["i", "begin", "length", "sequence_id", "offset"]).astype("int64")
        mine = group.iloc[placed["i"]].reset_index(drop=True)
        cut = [tokens[i][a : a + n].astype("<u4").tobytes() for i, a, n in zip(placed["i"], placed["begin"], placed["length"], strict=True)]
        return pd.DataFrame({
            "id": mine["id"], "known": mine["known"], "start": mine["start"] + placed["begin"], "length": placed["length"], "tokens": cut, "doc_tokens": mine["doc_tokens"],
            "sequence_id": placed["sequence_id"], "offset": placed["offset"],
        })

    return run


def pack(docs: DataFrame, tokenizer: str, id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end: int = 0, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """One row a piece: id, ``start``, ``length``, ``tokens`` (little-endian 32-bit ids), ``doc_tokens``, ``sequence_id``, ``offset``.

    A document is its ids and then id ``end``.  It is cut every ``capacity`` ids; whole pieces are sequences of their own, the
    remainders are packed first-fit decreasing, and bins left short are filled up by cutting the emptiest ones, so only
    sequences of power-of-two lengths fall short of ``capacity``.  Pieces are dealt to groups by a hash of their document, cut and copy
    number, one group for every ``group_bytes`` of text, so a group's size depends neither on a document's length nor on how often
    a row repeats; a group is packed in one task.  Null texts are empty: their only id is ``end``.  Null ids stay null; repeated
    rows are packed each; an empty table gives no rows; other columns are not read.
    """
    # a null id goes as 0 that isn't known: ids stay whole numbers in pandas
    own = F.col(id).cast("long")
    rows = docs.select(F.coalesce(own, F.lit(0)).alias("id"), own.isNotNull().alias("known"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text") + 4)).first()[0] or 0
    groups = max(1, -(-int(size) // group_bytes))
    pieces = rows.mapInPandas(_tokenise(tokenizer, end, capacity, groups), PIECES)
    placed = pieces.groupBy("grp").applyInPandas(_pack(tokenizer, capacity), PLACED)
    return placed.select(F.when(F.col("known"), F.col("id")).alias(id), "start", "length", "tokens", "doc_tokens", "sequence_id", "offset")
