"""The registered queries of this subpackage, and their SQL where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.llm import cross_entropy, decontaminate, fill_middle, line_dedup, packing, resampling, secrets_linked, simhash_cover, toxicity, turn_repair, url_trees, votes, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_cover.near_duplicates(table(spark, sf_dir, "documents"), words=3, radius=3)
    return found.select("doc_id", simhash_cover.hex64(F.col("fp")).alias("fingerprint"), "component_id")


@query
def op1_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, found = warc.archive_pages(table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", "refers_to")


ORACLES["op1_warc_revisits"] = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, upper(sha1(coalesce(html, ''))) AS h FROM pages),
d AS (SELECT page_id, payload_bytes,
        array_to_string(list_transform(range(0, 32), lambda i:
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + ((('0x' || h[1 + 5 * (i // 4) : 5 + 5 * (i // 4)])::BIGINT >> (15 - 5 * (i % 4))) & 31)]), '') AS payload_digest FROM p),
o AS (SELECT payload_digest, min(page_id) AS first FROM d GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM d JOIN o USING (payload_digest)
"""


@query
def op5_simhash_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = votes.edited_fingerprints(table(spark, sf_dir, "documents"), asked=F.col("id") % 50 == 0)
    hexed = [votes.hex64(F.col(c)).alias(n) for c, n in (("fp", "fingerprint"), ("edited_fp", "edited_fingerprint"))]
    return found.select("doc_id", "n_chars", "edited_sha256", *hexed, "near_edited", "near_next", "near_docs")


@query
def op7_linked_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets_linked.scan(table(spark, sf_dir, "documents"))
    base = F.sha2(secrets_linked.said(F.col("base")), 256)
    return found.select("doc_id", "n_assign", "n_access", "n_hex", base.alias("base_sha256"), secrets_linked.said(F.col("spans")).alias("spans"))


#: The rules of the query's contract.
RULES = [url_trees.Rule("block", "net", "/"), url_trees.Rule("allow", "example.net", "/en/"), url_trees.Rule("block", "example.com", "/de/"), url_trees.Rule("allow", "org", "/fr/")]


@query
def op8_url_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_trees.judge(table(spark, sf_dir, "pages"), RULES).select("page_id", "host", "path", "rule", "verdict", "score")


@query
def op4_packed_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return found.select("doc_id", "start", "length", F.crc32("tokens").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query
def op9_toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op10_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op2_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "log_weight", "key")


@query
def op6_cross_entropy_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    return cross_entropy.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), tokenizer)


@query
def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.drop_repeated(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLES["op12_line_dedup"] = r"""
WITH l AS (SELECT r, doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT r, doc_id, unnest(s) AS line, generate_subscripts(s, 1) AS pos
        FROM (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), E'\n') AS s FROM documents))),
g AS (SELECT k, max(doc_id) AS largest FROM l WHERE length(k) >= 20 GROUP BY k
      HAVING count(DISTINCT doc_id) + max(CASE WHEN doc_id IS NULL THEN 1 ELSE 0 END) >= 3),
t AS (SELECT r, doc_id, pos, line, g.k IS NOT NULL AND doc_id IS DISTINCT FROM g.largest AS gone FROM l LEFT JOIN g ON l.k = g.k)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, E'\n' ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM t GROUP BY r, doc_id
"""


@query
def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fill_middle.fill_in_middle(table(spark, sf_dir, "documents"))
    hashed = [F.sha2(c, 256).alias(f"{n}_sha256") for c, n in (("output", "output"), ("restored", "restored"))]
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *hashed)


ORACLES["op13_fill_in_middle"] = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h,
    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS t FROM documents),
e AS (SELECT doc_id, text, t, len(t)::BIGINT AS n, ('0x' || h[1:8])::BIGINT % (len(t) + 1) AS a, ('0x' || h[9:16])::BIGINT % (len(t) + 1) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR ('0x' || h[17:24])::BIGINT % 100 >= 50 THEN 'plain'
         WHEN ('0x' || h[25:32])::BIGINT % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM d),
f AS (SELECT *, array_to_string(t[1:least(a, b)], '') AS p, array_to_string(t[least(a, b) + 1:greatest(a, b)], '') AS m,
    array_to_string(t[greatest(a, b) + 1:], '') AS s FROM e)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM f
"""


@query
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    found, turns = turn_repair.repair(turn_repair.damage(conversations))
    hashed = turn_repair.digests(turns).withColumnRenamed("conv", "conv_id")
    every = conversations.select("conv_id").distinct()
    both = every.alias("c").join(found.alias("f"), turn_repair.same(["conv_id"], "c", "f"), "left").join(hashed.alias("h"), turn_repair.same(["conv_id"], "c", "h"), "left")
    counts = [F.coalesce(f"f.{c}", F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return both.select("c.conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


ORACLES["op11_conversation_repair"] = r"""
WITH RECURSIVE src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT)),
      lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 20 AS k FROM conversations),
dam AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, unnest(CASE WHEN k = 3 THEN [1, 2] ELSE [1] END) AS copy,
    CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM src WHERE k <> 0),
r AS (SELECT conv_id, turn, role, text, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body, role[1:1] AS ini,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM dam),
f AS (SELECT *, CASE WHEN body = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
                     WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault,
      CASE WHEN i > 1 AND lag(ini) OVER (PARTITION BY conv_id ORDER BY i) || ini NOT IN ('su', 'ua', 'au') THEN 1 ELSE 0 END AS illegal FROM r),
g AS (SELECT *, fault IN ('blank', 'duplicate') IS TRUE AS x, CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END AS t FROM f),
w AS (
  SELECT DISTINCT conv_id, n + 1 AS i, {'c': 0, 'a': ''} AS q0, {'c': 4, 'a': 'II'} AS qs, {'c': 2, 'a': 'I'} AS qu, {'c': 0, 'a': ''} AS qa FROM g
  UNION ALL
  SELECT conv_id, i, list_min([b0, {'c': qu.c + 2, 'a': 'I' || qu.a}]), list_min([bs, {'c': qu.c + 2, 'a': 'I' || qu.a}]), qu, qa FROM (
    SELECT conv_id, i, b0, bs, list_min([bu, {'c': ba.c + 2, 'a': 'I' || ba.a}]) AS qu, list_min([ba, {'c': bu.c + 2, 'a': 'I' || bu.a}]) AS qa FROM (
      SELECT g.conv_id, g.i,
        list_min([{'c': q0.c + 3, 'a': 'D' || q0.a}, CASE WHEN NOT x THEN {'c': qu.c + 2 + t, 'a': 'R' || qu.a} END,
                  CASE WHEN NOT x AND ini = 's' THEN {'c': qs.c + t, 'a': 'K' || qs.a} WHEN NOT x AND ini = 'u' THEN {'c': qu.c + t, 'a': 'K' || qu.a} END]) AS b0,
        list_min([{'c': qs.c + 3, 'a': 'D' || qs.a}, CASE WHEN NOT x THEN {'c': qu.c + 2 + t, 'a': 'R' || qu.a} END, CASE WHEN NOT x AND ini = 'u' THEN {'c': qu.c + t, 'a': 'K' || qu.a} END]) AS bs,
        list_min([{'c': qu.c + 3, 'a': 'D' || qu.a}, CASE WHEN NOT x THEN {'c': qa.c + 2 + t, 'a': 'R' || qa.a} END, CASE WHEN NOT x AND ini = 'a' THEN {'c': qa.c + t, 'a': 'K' || qa.a} END]) AS bu,
        list_min([{'c': qa.c + 3, 'a': 'D' || qa.a}, CASE WHEN NOT x THEN {'c': qu.c + 2 + t, 'a': 'R' || qu.a} END, CASE WHEN NOT x AND ini = 'u' THEN {'c': qu.c + t, 'a': 'K' || qu.a} END]) AS ba
      FROM w JOIN g ON g.conv_id IS NOT DISTINCT FROM w.conv_id AND g.i = w.i - 1))),
best AS (SELECT conv_id, q0.c AS cost, q0.a AS audit FROM w WHERE i = 1),
l AS (SELECT conv_id, unnest(string_split(audit, '')) AS e, generate_subscripts(string_split(audit, ''), 1) AS p FROM best),
m AS (SELECT *, count(*) FILTER (WHERE e <> 'I') OVER u AS i, count(*) FILTER (WHERE e <> 'D') OVER u AS j, count(*) FILTER (WHERE e <> 'D') OVER (PARTITION BY conv_id) AS k
      FROM l WINDOW u AS (PARTITION BY conv_id ORDER BY p)),
said AS (SELECT m.conv_id, sha256(coalesce(string_agg(CASE WHEN e = 'K' THEN role WHEN (k - j) % 2 = 0 THEN 'assistant' ELSE 'user' END || ':' || CASE WHEN e = 'I' THEN '' ELSE text END, chr(10) ORDER BY p)
      FILTER (WHERE e <> 'D'), '')) AS h FROM m JOIN g ON m.conv_id IS NOT DISTINCT FROM g.conv_id AND greatest(m.i, 1) = g.i GROUP BY m.conv_id),
n AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
      count(*) FILTER (WHERE fault = 'truncated') AS truncated, sum(illegal)::BIGINT AS illegal FROM g GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, coalesce(h, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN n ON c.conv_id IS NOT DISTINCT FROM n.conv_id
LEFT JOIN best ON c.conv_id IS NOT DISTINCT FROM best.conv_id LEFT JOIN said ON c.conv_id IS NOT DISTINCT FROM said.conv_id
"""
