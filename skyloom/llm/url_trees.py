"""URL verdicts by host and path rules, and by gradient-boosted trees on lexical features where no rule fits."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.llm.common import kept, lower_ascii

#: Rows the trees are fitted on at most: those of smallest hash, so the choice doesn't depend on the order of rows.
FIT_ROWS = 20_000
#: Labelled rows that the overall rate counts for in a suffix's rate.
PRIOR_ROWS = 20.0
FEATURES = [
    "f_url_len", "f_host_len", "f_path_len", "f_depth", "f_labels", "f_digits", "f_host_digits", "f_upper", "f_marks", "f_hyphens", "f_params", "f_query_len", "f_fragment",
    "f_secure", "f_www", "f_file", "f_entropy", "f_host_entropy", "f_first_len", "f_last_len", "f_rate1", "f_rate2",
]


@dataclass(frozen=True)
class Rule:
    """``verdict`` for ``host`` and its subdomains under a path that begins with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def said(self) -> str:
        return self.host + self.path


def with_host_and_path(pages: DataFrame, url: str = "url") -> DataFrame:
    """Adds ``host`` and ``path``; both are empty without ``://`` and for null urls."""
    u = F.coalesce(F.col(url), F.lit(""))
    rest = F.when(F.instr(u, "://") > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return pages.withColumn("host", lower_ascii(host)).withColumn("path", path)


def rule_of(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest fitting rule as ``(size, rule, verdict)``, null where none fits.

    The rules are a constant map by host: each of a host's suffixes is looked up there, so a row meets only the rules of its own hosts.
    """
    by_host: dict[str, list[dict[str, str]]] = {}
    for r in rules:
        by_host.setdefault(r.host, []).append({"path": r.path, "rule": r.said, "verdict": r.verdict})
    known = F.from_json(F.lit(json.dumps(by_host)), "map<string, array<struct<path string, rule string, verdict string>>>")
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    found = F.flatten(F.filter(F.transform(suffixes, lambda s: F.try_element_at(known, s)), lambda x: x.isNotNull()))
    fits = F.filter(found, lambda r: path.startswith(r["path"]))
    return F.array_max(F.transform(fits, lambda r: F.struct(F.length(r["rule"]).alias("size"), r["rule"].alias("rule"), r["verdict"].alias("verdict"))))


def _entropy(text: Column) -> Column:
    """Bits a character over letters, digits and a few marks."""
    low = lower_ascii(text)
    n = F.greatest(F.length(low), F.lit(1))
    share = lambda c: (F.length(low) - F.length(F.replace(low, c, F.lit("")))) / n
    letters = F.array(*[F.lit(c) for c in "abcdefghijklmnopqrstuvwxyz0123456789-._/"])
    return F.aggregate(F.transform(letters, share), F.lit(0.0), lambda a, p: a - F.when(p > 0, p * F.log2(p)).otherwise(0.0))


def _count(text: Column, characters: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, characters, ""))).cast("double")


def lexical(pages: DataFrame, url: str = "url") -> DataFrame:
    """Adds the features that a url's own letters give; needs ``host`` and ``path``."""
    u, h, p = F.coalesce(F.col(url), F.lit("")), F.col("host"), F.col("path")
    query = F.regexp_extract(u, r"\?([^#]*)", 1)
    labels, parts = F.split(h, r"\."), F.split(p, "/")
    size = lambda c: F.length(c).cast("double")
    n = F.greatest(size(u), F.lit(1.0))
    suffix1 = F.element_at(labels, -1)
    return pages.withColumns({
        "f_url_len": size(u), "f_host_len": size(h), "f_path_len": size(p), "f_depth": _count(p, "/"), "f_labels": F.size(labels).cast("double"),
        "f_digits": _count(u, "0123456789") / n, "f_host_digits": _count(h, "0123456789"), "f_upper": (n - size(F.translate(u, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))) / n,
        "f_marks": _count(u, "%_~@!$*,;:=&"), "f_hyphens": _count(h, "-"), "f_params": F.when(query == "", 0.0).otherwise(1.0 + _count(query, "&")), "f_query_len": size(query),
        "f_fragment": F.instr(u, "#").cast("boolean").cast("double"), "f_secure": u.startswith("https:").cast("double"), "f_www": h.startswith("www.").cast("double"),
        "f_file": p.rlike(r"\.[A-Za-z0-9]{1,5}$").cast("double"), "f_entropy": _entropy(u), "f_host_entropy": _entropy(h), "f_first_len": size(F.element_at(labels, 1)), "f_last_len": size(F.element_at(parts, -1)),
        "suffix1": suffix1, "suffix2": F.concat_ws(".", F.when(F.size(labels) > 1, F.element_at(F.reverse(labels), 2)), suffix1),
    })


def suffix_rates(labelled: DataFrame, suffix: str, name: str) -> DataFrame:
    """``(suffix, rate, hits, n)`` of every suffix over all labelled rows, drawn towards the overall rate."""
    by = labelled.groupBy(suffix).agg(F.count("*").alias("n"), F.sum("label").alias("hits"))
    whole = labelled.agg(F.avg("label").alias("overall"))
    rate = (F.col("hits") + PRIOR_ROWS * F.col("overall")) / (F.col("n") + PRIOR_ROWS)
    return by.crossJoin(F.broadcast(whole)).select(suffix, rate.alias(name), F.col("hits").alias(f"{name}_hits"), F.col("n").alias(f"{name}_n"))


def judge(pages: DataFrame, rules: list[Rule], url: str = "url", fit_rows: int = FIT_ROWS, rounds: int = 20, depth: int = 4) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule``, ``verdict`` and ``score`` (chance of block by the trees).

    Rows under a rule are the labelled urls.  Suffix statistics count all of them (leaving a labelled row's own label out of the
    rate it is given), the trees are fitted on at most ``fit_rows`` of those and judge every row.  A row's verdict is its
    rule's, else block at a score of a half or more.  Without labels of both verdicts there is nothing to learn: rows without a rule
    get the only verdict known, or allow.  Null urls have empty host and path; repeated rows and other columns are kept, and
    an empty table gives no rows.  Columns of ``pages`` named as the results are replaced.
    """
    others = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict", "score")]
    rows = with_host_and_path(pages.select(F.struct(*others).alias("_page"), F.col(url).alias("url")), "url")
    rows = rows.withColumn("_rule", rule_of(F.col("host"), F.col("path"), rules))
    known = lexical(rows.where(F.col("_rule").isNotNull()).select("url", "host", "path", "_rule"), "url")
    known = kept(known.withColumn("label", (F.col("_rule.verdict") == "block").cast("double")).drop("_rule"), "labelled")
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    rows = rows.select("*", F.col("_rule.rule").alias("rule"), F.col("_rule.verdict").alias("_said"))
    if len(counts) < 2:
        only = F.lit(float(next(iter(counts), 0.0)))
        verdict = F.coalesce("_said", F.when(only >= 0.5, "block").otherwise("allow"))
        return rows.select("_page.*", "host", "path", "rule", verdict.alias("verdict"), only.alias("score"))
    overall = counts[1.0] / sum(counts.values())
    rates = [kept(suffix_rates(known, s, n), "rates") for s, n in (("suffix1", "f_rate1"), ("suffix2", "f_rate2"))]

    def rated(df: DataFrame, own: bool) -> DataFrame:
        for r, s, n in zip(rates, ("suffix1", "suffix2"), ("f_rate1", "f_rate2"), strict=True):
            df = df.join(r, s, "left")  # as many rows as suffixes
            value = F.col(n)
            if own:
                value = (F.col(f"{n}_hits") - F.col("label") + PRIOR_ROWS * overall) / (F.col(f"{n}_n") - 1 + PRIOR_ROWS)
            df = df.withColumn(n, F.coalesce(value, F.lit(overall))).drop(f"{n}_hits", f"{n}_n")
        return df

    sample = known.orderBy(F.xxhash64("url"), "url").limit(fit_rows) if sum(counts.values()) > fit_rows else known
    assembler = VectorAssembler(inputCols=FEATURES, outputCol="_features")
    train = kept(rated(sample, True).select(*FEATURES, "label"), "train")
    trees = GBTClassifier(featuresCol="_features", labelCol="label", maxIter=rounds, maxDepth=depth, maxBins=64, stepSize=0.2, seed=7, minInstancesPerNode=5)
    model = trees.fit(assembler.transform(train)).setProbabilityCol("_p").setRawPredictionCol("_raw").setPredictionCol("_class")
    scored = model.transform(assembler.transform(rated(lexical(rows, "url"), False)))
    score = F.get(vector_to_array("_p"), F.lit(1))
    verdict = F.coalesce("_said", F.when(score >= 0.5, "block").otherwise("allow"))
    return scored.select("_page.*", "host", "path", "rule", verdict.alias("verdict"), score.alias("score"))
