"""Repair of a conversation's turns at least cost: signatures of faults, shared from their ends, decide all conversations' edits."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructType

from skyloom.llm.common import kept

SPACE = " \t\n\x0b\x0c\r"
USER, ASSISTANT = "user", "assistant"
#: Costs of the edits, and of a truncated row that stays.
DELETE, INSERT, KEEP, REROLE, TRUNCATED = 3, 2, 0, 2, 1
#: Rows of a conversation that are decided together; a longer one is cut into pieces that hand on their costs.
PIECE = 4096
ORDER = ["conv", "turn", "role", "digest"]
KEY = StructType().add("turn", LongType()).add("role", StringType()).add("digest", BinaryType())
PIECES = (
    StructType().add("conv", LongType()).add("part", IntegerType()).add("no", IntegerType()).add("sig", StringType())
    .add("first", StringType()).add("last", StringType()).add("illegal", LongType()).add("keys", ArrayType(KEY))
)

# States of the grammar (s?(ua)+)?: nothing yet, after s, after u, after a.
START, SYSTEM, ASKED, ANSWERED = range(4)
#: State after the only role that may come next, and that role.
NEXT = [(ASKED, USER), (ASKED, USER), (ANSWERED, ASSISTANT), (ASKED, USER)]
KEEPS = {(START, "s"): SYSTEM, (START, "u"): ASKED, (SYSTEM, "u"): ASKED, (ASKED, "a"): ANSWERED, (ANSWERED, "u"): ASKED}
NEVER = 1 << 40
LEGAL = frozenset(("su", "ua", "au"))


def arrow(kind: StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(kind)


def batch_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _pieces(schema: pa.Schema, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, no, out, size = TaskContext.get().partitionId(), 0, [], 0
        conv, sig, keys, initials = None, [], [], []

        def closed() -> tuple:
            illegal = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False))
            return conv, part, no, "".join(sig), initials[0], initials[-1], illegal, keys

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("conv", "turn", "role", "digest", "n", "fault", "first")]
            for c, turn, role, digest, n, fault, first in zip(*columns, strict=True):
                if c != conv and sig:
                    out.append(closed())
                    no, sig, keys, initials = no + 1, [], [], []
                conv = c
                initial = role[:1]
                for copy in range(n):
                    if len(sig) == most:
                        out.append(closed())
                        no, sig, keys, initials = no + 1, [], [], []
                        size += most
                    if copy or not first or fault == "blank":
                        sig.append("x")
                    else:
                        mark = initial if initial in ("s", "u", "a") else "o"
                        sig.append(mark.upper() if fault else mark)
                        keys.append({"turn": turn, "role": role, "digest": digest})
                    initials.append(initial)
                    if size >= 1 << 16:
                        yield batch_of(out, schema)
                        out, size = [], 0
            if out:
                yield batch_of(out, schema)
                out = []
        if sig:
            yield batch_of([closed()], schema)

    return run


class Automaton:
    """The suffixes of signatures as nodes, each with its cost to go and best first edit in every state of the grammar.

    Words come sorted from their ends, so those that share a suffix follow each other and a node is made once.  What a node adds to its
    successor depends on its letter and the successor's costs less their least: equal ones are one node of the minimal automaton.
    Of equal costs the edit of the least letter is taken; edits from one state with different letters never meet again before
    they differ, so this is the least of all audits.
    """

    def __init__(self) -> None:
        self.made: dict[tuple[str, tuple[int, ...]], tuple[tuple[int, ...], int, tuple[tuple[str, int], ...]]] = {}
        self.tail: str | None = None
        self.word = ""
        self.nodes: list[tuple[tuple[int, ...], int, tuple[tuple[str, int], ...]]] = []

    @staticmethod
    def end(tail: str) -> tuple[tuple[int, ...], tuple[tuple[str, int], ...]]:
        """Costs after the last letter: the conversation's end, or those that the next piece asks."""
        stay = tuple(("", q) for q in range(4))
        if tail:
            return tuple(int(c) for c in tail.split(",")), stay
        return (0, 2 * INSERT, INSERT, 0), (stay[START], ("I", ASKED), ("I", ANSWERED), stay[ANSWERED])

    @staticmethod
    def step(letter: str, after: tuple[int, ...]) -> tuple[tuple[int, ...], tuple[tuple[str, int], ...]]:
        kind, extra = letter.lower(), TRUNCATED if letter.isupper() else 0
        best = []
        for q in range(4):
            ways = [(after[q] + DELETE, "D", q)]
            if kind != "x":
                if (to := KEEPS.get((q, kind))) is not None:
                    ways.append((after[to] + KEEP + extra, "K", to))
                to = NEXT[q][0]
                ways.append((after[to] + REROLE + extra, "R", to))
            best.append(min(ways))
        asked = min(best[ASKED], (best[ANSWERED][0] + INSERT, "I", ANSWERED))
        answered = min(best[ANSWERED], (best[ASKED][0] + INSERT, "I", ASKED))
        first = [min(best[q], (asked[0] + INSERT, "I", ASKED)) for q in (START, SYSTEM)]
        whole = [*first, asked, answered]
        return tuple(min(w[0], NEVER) for w in whole), tuple(w[1:] for w in whole)

    def add(self, word: str, tail: str) -> None:
        """Makes ``word`` (its letters last first) the present one; nodes shared with the one before stay."""
        same = 0
        if tail != self.tail:
            costs, actions = self.end(tail)
            self.nodes, self.tail = [(costs, 0, actions)], tail
        else:
            while same < min(len(word), len(self.word)) and word[same] == self.word[same]:
                same += 1
            del self.nodes[same + 1 :]
        for letter in word[same:]:
            after, sum_, _ = self.nodes[-1]
            node = self.made.get((letter, after))
            if node is None:
                costs, actions = self.step(letter, after)
                least = min(costs)
                node = self.made[letter, after] = tuple(c if c == NEVER else c - least for c in costs), least, actions
            self.nodes.append((node[0], sum_ + node[1], node[2]))
        self.word = word

    def costs(self) -> list[int]:
        costs, sum_, _ = self.nodes[-1]
        return [c if c == NEVER else c + sum_ for c in costs]

    def audit(self, q: int) -> tuple[str, int]:
        """The best edits of the present word from a state, and the state after them."""
        out = []
        for _, _, actions in reversed(self.nodes):
            while True:
                letter, to = actions[q]
                out.append(letter)
                inserted = letter == "I"
                q = to
                if not inserted:
                    break
        return "".join(out), q


SOLVED = StructType().add("sig", StringType()).add("tail", StringType()).add("costs", ArrayType(LongType())).add("audits", ArrayType(StringType())).add("ends", ArrayType(IntegerType()))


def _solve(schema: pa.Schema, audits: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton()
        for batch in batches:
            for begin in range(0, len(batch), 256):
                some, out = batch.slice(begin, 256), []
                for word, tail in zip(some.column("word").to_pylist(), some.column("tail").to_pylist(), strict=True):
                    automaton.add(word, tail)
                    ways = [automaton.audit(q) for q in range(4)] if audits else []
                    out.append((word[::-1], tail, automaton.costs(), [a for a, _ in ways], [q for _, q in ways]))
                yield batch_of(out, schema)

    return run


def solved(words: DataFrame, audits: bool = True) -> DataFrame:
    """Every different ``(sig, tail)`` once: ``costs`` from each state and, if asked, the best ``audits`` and the states they end in."""
    each = words.select("tail", F.reverse("sig").alias("word")).distinct()
    each = each.repartitionByRange("tail", "word").sortWithinPartitions("tail", "word")
    return each.mapInArrow(_solve(arrow(SOLVED), audits), SOLVED)


#: Costs after a piece, were it to end in one given state.
ONLY = [",".join("0" if r == q else str(NEVER) for r in range(4)) for q in range(4)]


def _tails(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of each conversation from its last one: the costs that each one's end has to add to its own."""
    schema = arrow(StructType().add("conv", LongType()).add("part", IntegerType()).add("no", IntegerType()).add("tail", StringType()))
    before: tuple | None = None
    after: list[int] = []
    for batch in batches:
        out = []
        for conv, part, no, ways in zip(*[batch.column(c).to_pylist() for c in ("conv", "part", "no", "ways")], strict=True):
            if before != (conv,):
                before, tail, after = (conv,), "", list(Automaton.end("")[0])
            else:
                tail = ",".join(map(str, after))
            out.append((conv, part, no, tail))
            ways = [costs for _, costs in sorted((w["r"], w["costs"]) for w in ways)]
            now = [min(NEVER, *(ways[r][q] + after[r] for r in range(4))) for q in range(4)]
            after = [c if c == NEVER else c - min(now) for c in now]
        yield batch_of(out, schema)


def _starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of each conversation from its first one: the state that each one starts in."""
    schema = arrow(StructType().add("conv", LongType()).add("part", IntegerType()).add("no", IntegerType()).add("start", IntegerType()))
    before: tuple | None = None
    q = START
    for batch in batches:
        out = []
        for conv, part, no, ends in zip(*[batch.column(c).to_pylist() for c in ("conv", "part", "no", "ends")], strict=True):
            q = q if before == (conv,) else START
            before = (conv,)
            out.append((conv, part, no, q))
            q = ends[q]
        yield batch_of(out, schema)


DECIDED = StructType().add("conv", LongType()).add("part", IntegerType()).add("no", IntegerType()).add("audit", StringType()).add("cost", LongType())
EDIT = StructType().add("turn", LongType()).add("role", StringType()).add("digest", BinaryType()).add("place", IntegerType()).add("as", StringType())
DECIDED = DECIDED.add("illegal", LongType()).add("edits", ArrayType(EDIT))


def _decided(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            columns = [batch.column(c).to_pylist() for c in ("conv", "part", "no", "sig", "keys", "audit", "start", "illegal")]
            for conv, part, no, sig, keys, audit, q, illegal in zip(*columns, strict=True):
                letters, rows, edits, cost = iter(sig), iter(keys), [], 0
                for edit in audit:
                    letter = "" if edit == "I" else next(letters)
                    row = next(rows) if letter not in ("", "x") else {"turn": None, "role": None, "digest": None}
                    if edit == "D":
                        cost += DELETE
                        continue
                    role = row["role"]
                    if edit == "K":
                        cost, q = cost + KEEP, KEEPS[q, letter.lower()]
                    else:
                        cost += INSERT if edit == "I" else REROLE
                        q, role = NEXT[q]
                    cost += TRUNCATED * letter.isupper()
                    edits.append({**row, "place": len(edits), "as": role})
                out.append((conv, part, no, audit, cost, illegal, edits))
            yield batch_of(out, schema)

    return run


def same(keys: list[str], a: str, b: str) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
    return cond


def rows_of(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """``conv, turn, role, text, digest`` (the first half of its SHA-256); a null role or text is one space."""
    rows = turns.select(F.col(conv).cast("long").alias("conv"), F.col(turn).cast("long").alias("turn"), F.coalesce(role, F.lit(" ")).alias("role"), F.coalesce(text, F.lit(" ")).alias("text"))
    return rows.withColumn("digest", F.substring(F.unhex(F.sha2("text", 256)), 1, 16))


def repair(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", piece: int = PIECE) -> tuple[DataFrame, DataFrame]:
    """Two tables: one row a conversation, and one row ``conv, part, no, place, role, text`` a turn of the repaired ones, in this order.

    Of a conversation: ``gaps`` between its turns, rows that are ``blank``, ``duplicate`` or ``truncated`` (by the first that
    fits), ``illegal`` neighbours, and the least ``cost`` and first ``audit`` of edits (Delete, Insert, Keep, Rerole) after which roles
    read ``(s?(ua)+)?``.  Rows stand by turn (nulls first), then role and digest of the text; equal rows are counted once with
    their number.  They are dealt by ranges of that order and become letters of a signature there, so a conversation of any length lies in
    pieces of at most ``piece`` rows, and no task holds more of it.  Every different signature goes through the automaton once for
    all conversations.  A conversation of several pieces hands on four costs from piece to piece, last to first, then a state, first to last.
    A null conversation is one; a null turn has no place in the gaps; a null role or text is one space; other initials
    than s, u and a can't be kept; an empty table gives no rows; other columns are not read.
    """
    rows = rows_of(turns, conv, turn, role, text)
    body = F.rtrim("text", F.lit(SPACE))
    fault = F.when(body == "", "blank").when(~F.right(body, F.lit(1)).isin(".", "!", "?"), "truncated")
    slim = kept(rows.withColumn("fault", fault).groupBy(*ORDER, "fault").agg(F.count("*").alias("n")), "turns")
    seen = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    again = slim.groupBy("conv", "role", "digest").agg(F.min(seen).alias("seen"), F.count("*").alias("k")).where("k > 1")
    first = F.col("again.seen").isNull() | F.col("again.seen.turn").eqNullSafe(F.col("slim.turn"))
    marked = slim.alias("slim").join(again.alias("again"), same(["conv", "role", "digest"], "slim", "again"), "left").select("slim.*", first.alias("first"))
    marked = kept(marked, "marked")

    pieces = marked.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER).mapInArrow(_pieces(arrow(PIECES), piece), PIECES)
    pieces = kept(pieces, "pieces")
    many = pieces.groupBy("conv").agg(F.count("*").alias("k")).where("k > 1").select("conv")
    long = pieces.alias("p").join(many.alias("m"), same(["conv"], "p", "m"), "left_semi")
    place = ["conv", "part", "no"]

    # costs of every piece of several, by the state it would end in, then those after it
    ends = F.explode(F.array(*[F.lit(t) for t in ONLY])).alias("tail")
    ways = solved(long.select("sig", ends), audits=False)
    ways = ways.groupBy("sig").agg(F.collect_list(F.struct(F.array_position(F.array(*[F.lit(t) for t in ONLY]), F.col("tail")).alias("r"), "costs")).alias("ways"))
    backward = long.select(*place, "sig").join(ways, "sig").select(*place, "ways").repartition("conv").sortWithinPartitions("conv", F.desc("part"), F.desc("no"))
    tails = kept(backward.mapInArrow(_tails, "conv long, part int, no int, tail string"), "tails")
    with_tail = pieces.alias("p").join(tails.alias("t"), same(place, "p", "t"), "left").select("p.*", F.coalesce("t.tail", F.lit("")).alias("tail"), F.col("t.tail").isNull().alias("alone"))
    with_tail = kept(with_tail, "pieces")

    best = kept(solved(with_tail.select("sig", "tail")), "solved")
    told = with_tail.join(best.select("sig", "tail", "audits", "ends"), ["sig", "tail"])
    forward = told.where(~F.col("alone")).select(*place, "ends").repartition("conv").sortWithinPartitions(*place)
    starts = kept(forward.mapInArrow(_starts, "conv long, part int, no int, start int"), "starts")
    told = told.alias("p").join(starts.alias("s"), same(place, "p", "s"), "left").select("p.*", F.coalesce("s.start", F.lit(START)).alias("start"))
    told = told.withColumn("audit", F.get("audits", F.col("start"))).select(*place, "sig", "keys", "audit", "start", "illegal")
    decided = kept(told.mapInArrow(_decided(arrow(DECIDED)), DECIDED), "decided")

    # neighbours over the border of two pieces: one row a piece, the last initial goes to the piece that follows
    border = long.select(*place, "first", "last").repartition("conv").sortWithinPartitions(*place).mapInArrow(_borders, "conv long, illegal long")
    blank = F.col("fault") == "blank"
    own = ~F.coalesce(blank, F.lit(False)) & F.col("first")
    none = lambda kind: F.lit(None).cast(kind)
    counts = marked.groupBy("conv").agg(
        (F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps"),
        F.sum(F.when(blank, F.col("n")).otherwise(0)).alias("blank"),
        F.sum(F.when(blank, 0).otherwise(F.col("n") - F.col("first").cast("long"))).alias("duplicate"),
        F.sum(F.when(own & (F.col("fault") == "truncated"), 1).otherwise(0)).alias("truncated"),
    )
    parts = counts.select("*", none("long").alias("illegal"), none("long").alias("cost"), none("struct<part:int,no:int,audit:string>").alias("audit"))
    nought = [none("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated")]
    parts = parts.unionByName(decided.select("conv", *nought, "illegal", "cost", F.struct("part", "no", "audit").alias("audit")))
    parts = parts.unionByName(border.select("conv", *nought, "illegal", none("long").alias("cost"), none("struct<part:int,no:int,audit:string>").alias("audit")))
    total = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    audit = F.array_join(F.transform(F.array_sort(F.collect_list("audit")), lambda a: a["audit"]), "").alias("audit")
    found = parts.groupBy("conv").agg(*total, audit)

    edits = decided.select(*place, F.explode("edits").alias("e")).select(*place, "e.*")
    texts = rows.dropDuplicates(ORDER)
    edited = edits.where("digest is not null").alias("e").join(texts.alias("t"), same(ORDER, "e", "t")).select(*[f"e.{c}" for c in place], "e.place", F.col("e.as").alias("role"), "t.text")
    inserted = edits.where("digest is null").select(*place, "place", F.col("as").alias("role"), F.lit("").alias("text"))
    return found.withColumnRenamed("conv", conv), edited.unionByName(inserted)


def _borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = arrow(StructType().add("conv", LongType()).add("illegal", LongType()))
    before: tuple | None = None
    for batch in batches:
        out = []
        for conv, first, last in zip(*[batch.column(c).to_pylist() for c in ("conv", "first", "last")], strict=True):
            if before and before[0] == conv:
                out.append((conv, int(before[1] + first not in LEGAL)))
            before = conv, last
        yield batch_of(out, schema)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = arrow(StructType().add("conv", LongType()).add("sha256", StringType()))
    before, h = None, hashlib.sha256()
    for batch in batches:
        out = []
        for conv, role, text in zip(*[batch.column(c).to_pylist() for c in ("conv", "role", "text")], strict=True):
            if before == (conv,):
                h.update(b"\n")
            else:
                if before:
                    out.append((*before, h.hexdigest()))
                before, h = (conv,), hashlib.sha256()
            h.update(f"{role}:{text}".encode("utf-8", "surrogatepass"))
        yield batch_of(out, schema)
    if before:
        yield batch_of([(*before, h.hexdigest())], schema)


def digests(repaired: DataFrame) -> DataFrame:
    """``conv`` and the SHA-256 of its repaired turns ``role:text``, joined by line feeds.

    The digest of one text can't be split: a conversation's turns stream through one task in their order, sorted there with
    spilling; only the digest's state is held.  A conversation without turns has no row.
    """
    dealt = repaired.repartition("conv").sortWithinPartitions("conv", "part", "no", "place")
    return dealt.mapInArrow(_digests, "conv long, sha256 string")


def damage(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` with faults by CRC-32 of ``conv_id:turn`` modulo 20: 0 drops a row, 1 empties its text, 2
    removes its ends of sentences, 3 repeats it, 4 makes it a user's.  Nulls are one space in all of these."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    said = F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.regexp_replace(text("text"), "[.!?]", "")).otherwise(text("text"))
    role = F.when(F.col("k") == 4, USER).otherwise(text("role"))
    rows = turns.select("conv_id", "turn", "role", "text", kind.alias("k")).where("k <> 0")
    copies = F.explode(F.when(F.col("k") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return rows.select("conv_id", "turn", role.alias("role"), said.alias("text"), copies.alias("_copy")).drop("_copy")
