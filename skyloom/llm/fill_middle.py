"""Fill-in-the-middle: texts cut at two token borders and put together again in another order."""

from __future__ import annotations

import hashlib
import re
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

# The marks of the three parts, and the seed and shares of the forms.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, RATE, SPM = 42, 50, 80
#: Code points that decide a chunk's end, those of a chunk at least and at most, and in the mean.
WINDOW, SHORTEST, LONGEST, MEAN = 16, 64, 8192, 512
#: Code points of the chunks whose summaries a task keeps.
REMEMBERED = 8 << 20
RUN = re.compile(r"[^\x20\x09-\x0D]+")
SPACE = frozenset(" \t\n\x0b\x0c\r")


def ends_of(text: str) -> list[int]:
    """Ends of the chunks of a text, by content: where the rolling hash of the last ``WINDOW`` code points is nought modulo ``MEAN``.

    The hash of a window is built from those of its halves, so every place is hashed at once.
    """
    n = len(text)
    if n <= SHORTEST:
        return [n] if n else []
    h = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    width, base = 1, np.uint64(0xD6E8FEB86659FD93)
    with np.errstate(over="ignore"):
        while width < WINDOW:
            h = h[:-width] * base + h[width:]
            width, base = 2 * width, base * base
    found = np.flatnonzero((h >> np.uint64(40)) % np.uint64(MEAN) == 0) + WINDOW
    ends, last = [], 0
    for end in found.tolist():
        while end - last > LONGEST:
            last += LONGEST
            ends.append(last)
        if end - last >= SHORTEST and end < n:
            ends.append(last := end)
    while n - last > LONGEST:
        last += LONGEST
        ends.append(last)
    ends.append(n)
    return ends


@dataclass(frozen=True, slots=True)
class Summary:
    """What a chunk tells of its borders: runs of other than white space, and whether one stands at its begin and its end."""

    runs: int
    opens: bool
    closes: bool


class Summaries:
    """Summaries by content: a chunk's own code points are the key, so an equal hash of another chunk can't be taken for it."""

    def __init__(self, limit: int = REMEMBERED):
        self.of: OrderedDict[str, Summary] = OrderedDict()
        self.limit, self.size, self.hits = limit, 0, 0

    def __call__(self, chunk: str) -> Summary:
        s = self.of.get(chunk)
        if s is not None:
            self.hits += 1
            self.of.move_to_end(chunk)
            return s
        s = Summary(len(RUN.findall(chunk)), chunk[0] not in SPACE, chunk[-1] not in SPACE)
        self.of[chunk] = s
        self.size += len(chunk)
        while self.size > self.limit:
            self.size -= len(self.of.popitem(last=False)[0])
        return s


class Counted:
    """A text's chunks with the runs that end before each of them; a run over a border belongs to the chunk it ends in."""

    def __init__(self, text: str, summaries: Summaries):
        self.text, self.ends = text, ends_of(text)
        self.before: list[int] = []
        begin, runs, open_ = 0, 0, False
        for end in self.ends:
            s = summaries(text[begin:end])
            runs -= open_ and s.opens
            self.before.append(runs)
            runs += s.runs
            begin, open_ = end, s.closes
        self.runs = runs
        #: A token is a run with the white space before it; white space at the end is one more.
        self.tokens = runs + (bool(text) and not open_)

    def end_of(self, tokens: int) -> int:
        """Code points of the first ``tokens`` tokens: only the chunk that holds the last one's end is read."""
        if tokens == 0:
            return 0
        if tokens > self.runs:
            return len(self.text)
        lo, hi = 0, len(self.before)
        while hi - lo > 1:  # the last chunk before which fewer than ``tokens`` runs are told
            mid = (lo + hi) // 2
            lo, hi = (mid, hi) if self.before[mid] < tokens else (lo, mid)
        begin = self.ends[lo - 1] if lo else 0
        for i, m in enumerate(RUN.finditer(self.text, begin, self.ends[lo]), self.before[lo] + 1):
            if i == tokens:
                return m.end()
        raise AssertionError


def draws(id: str) -> tuple[int, int, int, int]:
    h = hashlib.sha256(f"{SEED}:{id}".encode()).hexdigest()
    return tuple(int(h[8 * i : 8 * i + 8], 16) for i in range(4))  # type: ignore[return-value]


def transformed(id: str, text: str, summaries: Summaries) -> tuple[int, str, int | None, int | None, str]:
    """Tokens, form, code points of prefix and middle (None if plain), and the text in its form."""
    counted = Counted(text, summaries)
    n = counted.tokens
    h1, h2, h3, h4 = draws(id)
    if not text or h3 % 100 >= RATE or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    a, b = sorted((counted.end_of(h1 % (n + 1)), counted.end_of(h2 % (n + 1))))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < SPM:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def restored(form: Column, output: Column) -> Column:
    """The text again, from its form and output alone."""
    first = F.when(form == "spm", F.lit(PREFIX)).otherwise(F.lit(SUFFIX))
    body = F.substr(output, F.lit(4))
    one = F.split_part(body, first, F.lit(1))
    rest = F.substr(body, F.char_length(one) + 4)
    two = F.split_part(rest, F.lit(MIDDLE), F.lit(1))
    three = F.substr(rest, F.char_length(two) + 4)
    return F.when(form == "plain", output).when(form == "spm", F.concat(two, three, one)).otherwise(F.concat(one, three, two))


MADE = StructType().add("n", LongType()).add("form", StringType()).add("prefix_chars", LongType()).add("middle_chars", LongType()).add("output", StringType())


@F.pandas_udf(MADE)
def _made(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    summaries = Summaries()
    for ids, texts in batches:
        out = pd.DataFrame([transformed(i, t, summaries) for i, t in zip(ids, texts, strict=True)], columns=MADE.names)
        yield out.astype({"prefix_chars": "Int64", "middle_chars": "Int64"})


def fill_in_middle(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: id, ``n`` (tokens), ``form``, ``prefix_chars``, ``middle_chars``, ``output`` and ``restored``, its text again.

    Chunks end where their content says, so texts that share a passage share its chunks; a task keeps the summaries of the last
    ``REMEMBERED`` code points of chunks by their content.  Sums over a text's chunks tell its tokens and the chunk of each cut.  Where a
    text is cut depends on its id and tokens alone.  Null texts count as empty, empty ones are plain; a null id draws as the
    empty string; repeated rows come out each; an empty table gives no rows; other columns are not read.
    """
    named = F.coalesce(F.col(id).cast("string"), F.lit(""))
    made = docs.select(F.col(id).alias(id), _made(named, F.coalesce(F.col(text), F.lit(""))).alias("_m"))
    return made.select(id, "_m.*", restored(F.col("_m.form"), F.col("_m.output")).alias("restored"))
