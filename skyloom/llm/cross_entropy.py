"""Cross-entropy difference: documents scored by matched n-gram models of target and background text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.llm.common import kept
from skyloom.llm.packing import encoder

#: Bytes of text that a block of documents is meant to hold; the number of blocks follows the input.
BLOCK_BYTES = 16_000_000
#: Discount of a seen pair, given to the shorter history; weight of a token that no text has.
DISCOUNT, SMOOTHING = 0.75, 0.1
START = 0xFFFF
#: Blocks over which the texts of one id are dealt, should an id hold very many rows.
SPREAD = 16


def pairs_of(ids: np.ndarray) -> np.ndarray:
    """Each token with the one before it, ``START`` before the first, as one number.  Vocabularies have under 2^16 - 1 tokens."""
    before = np.concatenate([[START], ids[:-1]]).astype(np.uint32) if len(ids) else np.zeros(0, np.uint32)
    return before << np.uint32(16) | ids.astype(np.uint32)


def _tokens(path: str, texts: pd.Series) -> list[np.ndarray]:
    bpe = encoder(path)
    return [bpe.encode_to_numpy(t, disallowed_special=()) for t in texts]


def _alike(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Equal rows of a batch as one, with their number, before anything is dealt out: so many rows of one document stay few."""
    for batch in batches:
        yield batch.groupby(["id", "known", "text"], sort=False, as_index=False).size().rename(columns={"size": "copies"})


def _counted(path: str):
    def run(key: tuple, docs: pd.DataFrame, labels: pd.DataFrame) -> pd.DataFrame:
        target = (docs["id"].isin(set(labels["id"])) & docs["known"]).to_numpy()
        pairs = [pairs_of(t) for t in _tokens(path, docs["text"])]
        sizes, copies = [len(p) for p in pairs], docs["copies"].to_numpy()
        pair, at = np.unique(np.concatenate([np.zeros(0, np.uint32), *pairs]), return_inverse=True)
        count = lambda weight: np.bincount(at, np.repeat(weight, sizes), len(pair)).astype(np.int64)
        return pd.DataFrame({"block": np.full(len(pair), key[0]), "pair": pair.astype(np.int64), "target": count(copies * target), "background": count(copies)})

    return run


def _scored(path: str):
    def run(key: tuple, docs: pd.DataFrame, losses: pd.DataFrame) -> pd.DataFrame:
        losses = losses.sort_values("pair")
        known, t, b = losses["pair"].to_numpy(), losses["target_loss"].to_numpy(), losses["background_loss"].to_numpy()
        out = []
        for id, known_id, copies, ids in zip(docs["id"], docs["known"], docs["copies"], _tokens(path, docs["text"]), strict=True):
            at = np.searchsorted(known, pairs_of(ids).astype(np.int64))
            n = len(ids)
            out.append((id, known_id, copies, n, float(t[at].sum() / n) if n else 0.0, float(b[at].sum() / n) if n else 0.0))
        return pd.DataFrame(out, columns=["id", "known", "copies", "tokens", "target_loss", "background_loss"])

    return run


def losses_of(counts: DataFrame, name: str, vocabulary: int) -> DataFrame:
    """``counts`` (one row a pair, with ``before`` and ``after``) with the loss of each pair in nats under one model.

    Absolute discounting: a seen pair keeps its count less ``DISCOUNT``; what that frees within a history goes to single
    tokens, smoothed over the shared vocabulary.  So both models give every pair a probability, seen by them or not.
    """
    total = F.sum(name)
    before = counts.groupBy("before").agg(total.alias("h_n"), F.sum((F.col(name) > 0).cast("long")).alias("h_kinds"))
    after = counts.groupBy("after").agg(total.alias("w_n"))
    whole = counts.agg(F.sum(name).alias("all_n"))
    single = (F.coalesce("w_n", F.lit(0)) + SMOOTHING) / (F.coalesce("all_n", F.lit(0)) + SMOOTHING * vocabulary)
    free = F.when(F.coalesce("h_n", F.lit(0)) > 0, DISCOUNT * F.col("h_kinds") / F.col("h_n")).otherwise(1.0)
    seen = F.when(F.coalesce("h_n", F.lit(0)) > 0, F.greatest(F.col(name) - DISCOUNT, F.lit(0.0)) / F.col("h_n")).otherwise(0.0)
    # histories and tokens are members of the vocabulary: at most so many rows
    joined = counts.join(F.broadcast(before), "before").join(F.broadcast(after), "after").crossJoin(whole)
    return joined.withColumn(f"{name}_loss", -F.log(seen + free * single)).drop("h_n", "h_kinds", "w_n", "all_n")


def score(docs: DataFrame, labels: DataFrame, tokenizer: str, id: str = "doc_id", text: str = "text", label: str = "quality", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row a document: id, ``tokens``, ``target_loss``, ``background_loss`` (nats a token), ``difference`` (target less background).

    The target model counts the token pairs of documents labelled 1, the background model those of all documents; both are bigram models
    over the tokenizer's one vocabulary.  Documents are dealt to blocks by a hash of id and text, one for every
    ``block_bytes`` of text; equal rows are told once a batch, with their number.  A block sends its different pairs with their counts, never its tokens; the sums over all blocks are the
    models, and a block gets back the losses of its own pairs.  No model is sent whole to any task.  Labels go to the ``SPREAD``
    blocks that their id's texts may be in.  Null and empty texts have no token and losses of 0; null ids are
    background; repeated rows are scored (and counted) each; an empty table gives no rows; other columns are not read.
    """
    # a null id goes as 0 that isn't known: ids stay whole numbers in pandas
    real = F.col(id).cast("long")
    rows = docs.select(F.coalesce(real, F.lit(0)).alias("id"), real.isNotNull().alias("known"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    blocks = max(1, -(-int(size) // block_bytes))
    block = lambda part: F.pmod(F.xxhash64(F.col("id"), part), F.lit(blocks)).alias("block")
    own = F.when(~F.col("known"), F.xxhash64("text")).otherwise(F.pmod(F.xxhash64("text"), F.lit(SPREAD)))
    few = rows.mapInPandas(_alike, "id long, known boolean, text string, copies long")
    dealt = few.select(block(own), "id", "known", "text", "copies").groupBy("block")
    chosen = labels.where(F.col(label) == 1).select(F.col(id).cast("long").alias("id")).where("id is not null").distinct()
    chosen = chosen.select("id", F.explode(F.array(*[F.lit(i).cast("long") for i in range(SPREAD)])).alias("part"))
    marked = chosen.select(block(F.col("part")), "id").groupBy("block")
    counts = kept(dealt.cogroup(marked).applyInPandas(_counted(tokenizer), "block long, pair long, target long, background long"), "pairs")
    model = counts.groupBy("pair").agg(F.sum("target").alias("target"), F.sum("background").alias("background"))
    model = kept(model.select("*", F.shiftright("pair", 16).alias("before"), F.col("pair").bitwiseAND(F.lit(0xFFFF)).alias("after")), "model")
    size_of = encoder(tokenizer).n_vocab
    losses = losses_of(losses_of(model, "target", size_of), "background", size_of).select("pair", "target_loss", "background_loss")
    asked = counts.select("block", "pair").join(losses, "pair").groupBy("block")
    out = dealt.cogroup(asked).applyInPandas(_scored(tokenizer), "id long, known boolean, copies long, tokens long, target_loss double, background_loss double")
    out = out.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    difference = (F.col("target_loss") - F.col("background_loss")).alias("difference")
    return out.select(F.when(F.col("known"), F.col("id")).alias(id), "tokens", "target_loss", "background_loss", difference)
