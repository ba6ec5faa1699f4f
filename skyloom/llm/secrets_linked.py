"""Secrets in texts: sure ones by pattern, weak parts of credentials where complementary parts stand together."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyloom.llm.common import kept

#: What a part says of a credential.
IDENTIFIER, SECRET, ENDPOINT = "identifier", "secret", "endpoint"


@dataclass(frozen=True)
class Kind:
    """A pattern of Java's syntax.  ``least`` is the length asked of group ``group``; ``hint`` a cheap test that a text with a match passes."""

    name: str
    pattern: str
    part: str
    base: bool
    group: int = 0
    least: int = 1
    hint: str = ""


# The three base kinds in their order.
BASE = [
    Kind("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", SECRET, True, 1, 6, r"(?i:password|passwd|secret|token|api_?key)"),
    Kind("access", r"AKIA[A-Z0-9]+", IDENTIFIER, True, 0, 20, r"AKIA"),
    Kind("hex", r"[0-9a-f]+", SECRET, True, 0, 24, r"[0-9a-f]{24}"),
]
WEAK = [
    Kind("weak_id", r"(?<![A-Za-z0-9])(?:ASIA|AIDA|AROA|AGPA|GOOG)[A-Z0-9]{12,}(?![A-Za-z0-9])", IDENTIFIER, False, hint=r"ASIA|AIDA|AROA|AGPA|GOOG"),
    Kind("user", r"""(?<![A-Za-z0-9])(?i:user(?:name)?|login|account(?:_id)?|client_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9._@-]+)""", IDENTIFIER, False, 1, 3, r"(?i:user|login|account|client)"),
    Kind("weak_secret", r"(?<![A-Za-z0-9+/=])(?=[A-Za-z+/]*[0-9])(?=[0-9a-z+/]*[A-Z])(?=[0-9A-Z+/]*[a-z])[A-Za-z0-9+/]{20,}={0,2}(?![A-Za-z0-9+/=])", SECRET, False, hint=r"[A-Za-z0-9+/]{20}"),
    Kind("weak_hex", r"(?<![0-9A-Za-z])[0-9a-f]{16,23}(?![0-9A-Za-z])", SECRET, False, hint=r"[0-9a-f]{16}"),
    Kind("endpoint", r"(?i:https?|jdbc:[a-z]+|mongodb|postgres(?:ql)?|mysql|redis|amqps?|s3)://[A-Za-z0-9.:@_-]+", ENDPOINT, False, hint=r"://"),
]
KINDS = [*BASE, *WEAK]
#: Code points between two parts of one credential, at most.
SCOPE = 256


def _found(text: Column, kind: Kind) -> Column:
    """Lengths of every match of a kind, of the gap before it and of its value, null where the cheap test fails."""
    matches = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    gaps = F.transform(F.split(text, kind.pattern, -1), F.char_length)
    value = lambda m: F.char_length(F.regexp_extract(m, kind.pattern, kind.group) if kind.group else m)
    rows = F.zip_with(gaps, F.transform(matches, lambda m: F.struct(F.char_length(m).alias("size"), value(m).alias("value"))), lambda g, m: F.struct(g.alias("gap"), m["size"].alias("size"), m["value"].alias("value")))
    return F.when(text.rlike(kind.hint), F.filter(rows, lambda r: r["size"].isNotNull()))


def matches_of(texts: DataFrame, keys: list[str], text: str, kinds: list[Kind] | None = None) -> DataFrame:
    """Spans of every kind: ``keys, kind, start, end`` in code points, end exclusive, leftmost and non-overlapping in each kind.

    A text is cut at a pattern's matches; running sums of the lengths of gaps and matches give the places.  Matches that fail the
    length test are dropped after that, so they still cover what they matched.  ``keys`` must name a text.
    """
    kinds = KINDS if kinds is None else kinds
    named = F.array(*[F.struct(F.lit(i).alias("kind"), _found(F.col(text), k).alias("found")) for i, k in enumerate(kinds)])
    lists = texts.select(*keys, F.explode(named).alias("_l")).select(*keys, F.col("_l.kind").alias("kind"), F.col("_l.found").alias("found")).where(F.size("found") > 0)
    rows = lists.dropDuplicates([*keys, "kind"]).select(*keys, "kind", F.posexplode("found").alias("at", "m"))
    before = Window.partitionBy(*keys, "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select(*keys, "kind", "m.size", "m.value", F.sum(F.col("m.gap") + F.col("m.size")).over(before).alias("end"))
    least = F.element_at(F.array(*[F.lit(k.least) for k in kinds]), F.col("kind") + 1)
    return rows.where(F.col("value") >= least).select(*keys, "kind", (F.col("end") - F.col("size")).alias("start"), "end")


def linked(spans: DataFrame, keys: list[str], scope: int = SCOPE) -> DataFrame:
    """The weak spans with complementary parts no more than ``scope`` code points away.

    An identifier needs a secret, a secret an identifier, an endpoint both.  Parts meet by an interval join inside scopes: every
    part lies in each cell of ``scope`` code points that it covers, and a weak part asks each cell that holds a code point of
    a part in reach: one that ends at ``start - scope`` has its last code point before that.  So no length loses a pair.  A
    cell holds at most ``scope`` parts of a kind, and what comes out is one row a part and complementary role, not its pairs.
    """
    roles = F.array(*[F.lit(k.part) for k in KINDS])
    weak = F.array(*[F.lit(not k.base) for k in KINDS])
    parts = spans.withColumn("role", F.element_at(roles, F.col("kind") + 1))
    cells = lambda first, last: F.explode(F.sequence(F.floor(first / scope), F.floor(last / scope)))
    asks = parts.where(F.element_at(weak, F.col("kind") + 1))
    asks = asks.withColumn("cell", cells(F.col("start") - scope - 1, F.col("end") + scope))
    others = parts.where(F.col("role") != ENDPOINT).select(*keys, cells(F.col("start"), F.col("end") - 1).alias("cell"), F.col("role").alias("other"), F.col("start").alias("s"), F.col("end").alias("e"))
    met = asks.join(others, [*keys, "cell"]).where((F.col("role") != F.col("other")) & (F.col("s") - F.col("end") <= scope) & (F.col("start") - F.col("e") <= scope))
    roles_met = met.groupBy(*keys, "kind", "start", "end", "role").agg(F.count_distinct("other").alias("n"))
    return roles_met.where((F.col("role") != ENDPOINT) | (F.col("n") == 2)).select(*keys, "kind", "start", "end")


def scan(docs: DataFrame, id: str = "doc_id", text: str = "text", scope: int = SCOPE) -> DataFrame:
    """One row a document: id, counts of the base kinds, ``base`` and ``spans`` as sorted arrays of ``(start, kind, end)``.

    Null texts count as empty.  A document is known by id and text, so repeated rows (and null ids) each get their own whole
    result.  Documents without a find have noughts and empty arrays; an empty table gives no rows; other columns are not read.
    """
    rows = docs.select(F.col(id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("key", document_key(F.col("id"), F.col("text")))
    found = spans_of(rows, "text", scope)
    none = F.array().cast(found.schema["spans"].dataType)
    both = rows.select("id", "key").join(found, "key", "left")
    counts = [F.coalesce(f"n_{k.name}", F.lit(0).cast("long")).alias(f"n_{k.name}") for k in BASE]
    return both.select(F.col("id").alias(id), *counts, F.coalesce("base", none).alias("base"), F.coalesce("spans", none).alias("spans"))


def document_key(id: Column, text: Column) -> Column:
    """A document's id and the SHA-256 of its text; a null id leaves the digest alone."""
    return F.concat_ws(":", id.cast("string"), F.sha2(F.coalesce(text, F.lit("")), 256))


def spans_of(rows: DataFrame, text: str, scope: int = SCOPE) -> DataFrame:
    """``key``, counts of the base kinds, ``base`` and ``spans``, for every different ``key`` of ``rows`` with a find."""
    spans = kept(matches_of(rows, ["key"], text), "spans")
    known = spans.where(F.col("kind") < len(BASE)).unionByName(linked(spans, ["key"], scope))
    one = F.struct(F.col("start"), F.col("kind"), F.col("end"))
    counts = [F.sum(F.when(F.col("kind") == i, 1).otherwise(0)).alias(f"n_{k.name}") for i, k in enumerate(BASE)]
    base = F.array_sort(F.collect_list(F.when(F.col("kind") < len(BASE), one))).alias("base")
    return known.groupBy("key").agg(*counts, base, F.array_sort(F.collect_list(one)).alias("spans"))


def said(spans: Column) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""
    names = F.array(*[F.lit(k.name) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def masked(text: Column, spans: Column) -> Column:
    """``text`` with every span, overlapping ones as one, replaced by ``[secret]``; spans as ``scan`` sorts them."""
    state = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))
    cut = lambda a, s: text.substr((a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int"))
    out = lambda a, s: F.when(s["start"] >= a["at"], F.concat(a["out"], cut(a, s), F.lit("[secret]"))).otherwise(a["out"])
    end = F.aggregate(spans, state, lambda a, s: F.struct(F.greatest(a["at"], s["end"]).alias("at"), out(a, s).alias("out")))
    return F.when(F.size(spans) > 0, F.concat(end["out"], text.substr((end["at"] + 1).cast("int"), F.char_length(text)))).otherwise(text)


def mask_documents(docs: DataFrame, id: str = "doc_id", text: str = "text", scope: int = SCOPE) -> DataFrame:
    """``docs`` with every found span of ``text`` masked, all other columns and rows as they were."""
    rows = docs.select(F.struct("*").alias("row"), document_key(F.col(id), F.col(text)).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    both = rows.join(spans_of(rows, "text", scope).select("key", "spans"), "key", "left")
    clean = F.when(F.col("spans").isNull(), F.col(f"row.{text}")).otherwise(masked(F.col("text"), F.col("spans")))
    return both.withColumn("row", F.col("row").withField(text, clean)).select("row.*")
