"""Filling fixed-capacity containers with documents: sum-of-squares packing.

Each document is placed where the sum over all residual gaps of the squared number of open containers with that gap becomes
smallest. Documents longer than a container are cut into full containers and one remainder, which is packed like a document.

Packing is online within a shard. Shards are formed by a hash of the document id and hold about ``shard_docs`` documents each,
whatever the layout of the input, so no task grows with the corpus; each is packed by a task of its own, and only ids and token counts are shuffled. The space
left in the last open containers of a shard is a fixed amount against thousands of full ones.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.tokens import TOKENIZER, with_tokens

CAPACITY = 2_048
SHARD_DOCS = 40_000


def sum_of_squares(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container number of each item, in the order given; items of size 0 go into the first container.

    Ties between gaps are broken towards the smallest gap that results, between open containers of one gap towards the one opened
    into that gap last.
    """
    counts = np.zeros(capacity + 1, np.int64)  # counts[g]: open containers with gap g, 0 < g < capacity
    stacks: list[list[int]] = [[] for _ in range(capacity)]
    where = np.empty(len(sizes), np.int64)
    opened = 0
    for i, s in enumerate(sizes.tolist()):
        if s == 0:
            where[i] = 0
            continue
        # change of the sum when a gap g becomes g - s: 2 (N[g-s] - N[g]) + 2, where the gap 0 isn't counted
        after = counts[0 : capacity - s + 1] if s <= capacity else counts[:0]
        delta = 2 * (after[: capacity - s] - counts[s:capacity]) + 2
        if len(delta):
            delta[0] -= 2 * after[0] + 1
            delta = np.where(counts[s:capacity] > 0, delta, np.iinfo(np.int64).max)
        fresh = 2 * counts[capacity - s] + 1 if s < capacity else 0
        best = int(delta.argmin()) if len(delta) else -1
        if best >= 0 and delta[best] <= fresh:
            g = s + best
            box = stacks[g].pop()
            counts[g] -= 1
        else:
            g, box = capacity, opened
            opened += 1
        where[i] = box
        if g - s > 0:
            counts[g - s] += 1
            stacks[g - s].append(box)
    return where


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, shard_docs: int = SHARD_DOCS, tokenizer: str = TOKENIZER) -> DataFrame:
    """One row per document piece: container_id, doc_id, piece, token_start, token_end, n_tokens, doc_tokens.

    Pieces of one document cover its tokens without gap or overlap; only a document longer than ``capacity`` has several.
    Null and empty texts have one piece of no tokens. Repeated texts are separate documents. An empty table gives an empty result.
    """
    sized = with_tokens(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text")), "_text", "doc_tokens", tokenizer)
    shards = max(1, -(-docs.count() // shard_docs))
    # every shard is one task of its own, however few bytes it has: packing is bound by time
    sized = sized.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int")).repartitionById(shards, "shard")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("doc_id", kind="stable")
        n = group["doc_tokens"].to_numpy()
        pieces = np.maximum(1, -(-n // capacity))
        at = np.repeat(np.arange(len(group)), pieces)
        piece = np.arange(len(at)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        size = np.minimum(capacity, n[at] - piece * capacity)
        box = sum_of_squares(size, capacity)
        shard = int(group["shard"].iloc[0])
        return pd.DataFrame({
            "container_id": (shard << 32) + box, "doc_id": group["doc_id"].to_numpy()[at], "piece": piece.astype("int32"),
            "token_start": piece * capacity, "token_end": piece * capacity + size, "n_tokens": size, "doc_tokens": n[at],
        })

    kind = dict(docs.dtypes)[doc_id]
    return sized.groupBy("shard").applyInPandas(run, f"container_id bigint, doc_id {kind}, piece int, token_start bigint, token_end bigint, n_tokens bigint, doc_tokens bigint")


def fill_report(assignment: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, tokens, capacity of all containers and the share of it left unused."""
    per = assignment.groupBy("container_id").agg(F.sum("n_tokens").alias("used"), F.count(F.lit(1)).alias("pieces"))
    return per.agg(
        F.count(F.lit(1)).alias("containers"), F.coalesce(F.sum("pieces"), F.lit(0)).alias("pieces"), F.coalesce(F.sum("used"), F.lit(0)).alias("tokens"),
        F.max("used").alias("fullest"), (1 - F.try_divide(F.sum("used"), F.count(F.lit(1)) * F.lit(capacity))).alias("unused_share"),
    )
