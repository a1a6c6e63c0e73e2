"""Mixing sources to target weights: Sainte-Laguë apportionment of equal-token blocks.

The mixture has as many tokens as the corpus, in ``blocks`` equal blocks. Blocks are allocated to sources by highest quotients
share / (2 a + 1), for every shard of the mixture as the difference of two house sizes (the method is house-monotone), which gives
integer quotas per shard; a source ends at its cap of max_repeats passes.

The documents of a source stand in a seeded random order (a hash), in which a document belongs to the block where its first token
lies. The position comes from two prefix sums: over hash buckets of a source, and within a bucket; a source with a third of all
documents is thus spread over its buckets. Each pass over a source takes its blocks from another seeded start, so a block's place
in the sequence is arithmetic and needs no sort.
"""

from __future__ import annotations

import hashlib
from functools import cached_property

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.llm.tokens import TOKENIZER, with_tokens
from tallyforge.session import materialize

BLOCKS = 10_000
SHARDS = 16
#: Documents per hash bucket aimed at; the buckets of a source are one window of one row each.
BUCKET_DOCS = 20_000
MAX_SOURCES = 10_000
SEED = 20_240_501


def apportion(shares: dict[str, float], seats: int) -> dict[str, int]:
    """Sainte-Laguë seats. Equal quotients go to the smaller name. The divisor is found by halving, so time doesn't grow with the seats."""
    live = {k: v for k, v in shares.items() if v > 0}
    out = dict.fromkeys(shares, 0)
    if not live or seats <= 0:
        return out
    lo, hi = 0.0, sum(live.values())
    give = lambda d: {k: int(v / d + 0.5) for k, v in live.items()}
    lo = min(v for v in live.values()) / (4 * seats + 4)
    while sum(give(lo).values()) < seats:
        lo /= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        if sum(give(mid).values()) >= seats:
            lo = mid
        else:
            hi = mid
    got = give(hi)  # at most seats; the rest by highest quotients
    for _ in range(seats - sum(got.values())):
        k = min(live, key=lambda k: (-live[k] / (2 * got[k] + 1), k))
        got[k] += 1
    return out | got


def _start(seed: int, source: str, turn: int, n: int) -> int:
    return int.from_bytes(hashlib.sha256(f"{seed}/{source}/{turn}".encode()).digest()[:8], "big") % max(1, n)


class Mixture:
    """``docs`` has doc_id, source and text; ``targets`` source, target_share and max_repeats (at most MAX_SOURCES rows).

    Sources are compared exactly as written. Documents without a source, or of a source without a target, count in the total and are not
    selected. Of targets given twice, shares are added and the larger max_repeats holds; null shares and repeats count as 0.
    Empty documents keep their place and weigh nothing. An empty corpus gives an empty mixture. A share is one of the tokens of all documents: what a capped
    source can't give is left out, not made up for by others, so that every other source has its target to a block.
    Nothing runs before a result is asked for.
    """

    def __init__(self, docs: DataFrame, targets: DataFrame, blocks: int = BLOCKS, shards: int = SHARDS, seed: int = SEED, tokenizer: str = TOKENIZER):
        self._docs, self._targets, self._blocks, self.shards, self.seed, self._tokenizer = docs, targets, blocks, shards, seed, tokenizer

    @cached_property
    def _wanted(self) -> dict:
        rows = self._targets.where(F.col("source").isNotNull()).groupBy("source").agg(F.coalesce(F.sum("target_share"), F.lit(0.0)).alias("share"), F.coalesce(F.max("max_repeats"), F.lit(0)).alias("repeats")).limit(MAX_SOURCES + 1).collect()
        if len(rows) > MAX_SOURCES:
            raise ValueError(f"more than {MAX_SOURCES} sources")
        return {r.source: (float(r.share), int(r.repeats)) for r in rows}

    @cached_property
    def tokens(self) -> DataFrame:
        """Ids, sources and token counts: the one pass over the texts; what follows reads them from the shared folder."""
        return materialize(with_tokens(self._docs.select("doc_id", "source", "text"), "text", path=self._tokenizer))

    @cached_property
    def _counts(self) -> dict:
        """Source (None: all that have no target) -> tokens and documents. At most one row per target."""
        wanted = F.col("source").isin(list(self._wanted)) if self._wanted else F.lit(False)
        sums = self.tokens.groupBy(F.when(wanted, F.col("source")).alias("source")).agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs")).collect()
        return {r.source: (int(r.tokens), int(r.docs)) for r in sums}

    @property
    def total(self) -> int:
        return sum(t for t, _ in self._counts.values())

    @property
    def block(self) -> int:
        return max(1, -(-self.total // self._blocks))

    @cached_property
    def quotas(self) -> dict[str, dict]:
        """Per source: share, repeats, tokens, docs, its number of blocks, the seats it is due, the quota its repeats allow of them, and where each shard ends in it."""
        seats = -(-self.total // self.block) if self.total else 0
        due = apportion({s: share for s, (share, _) in self._wanted.items()}, seats)
        out = {}
        for s, (share, repeats) in self._wanted.items():
            tokens, docs = self._counts.get(s, (0, 0))
            n = -(-tokens // self.block)
            out[s] = {"share": share, "repeats": repeats, "tokens": tokens, "docs": docs, "blocks": n, "due": due[s], "quota": min(due[s], repeats * n), "ends": []}
        # quotas are apportioned to the shards, so that each has its part of every source, of capped ones too
        quota = {s: float(q["quota"]) for s, q in out.items()}
        for k in range(1, self.shards + 1):
            for s, n in apportion(quota, int(sum(quota.values())) * k // self.shards).items():
                out[s]["ends"].append(n)
        return out

    @cached_property
    def rows(self) -> DataFrame:
        return self._select(self.tokens.sparkSession, max(1, -(-sum(d for _, d in self._counts.values()) // BUCKET_DOCS)), self.seed)

    def _select(self, spark, buckets: int, seed: int) -> DataFrame:
        facts = [(s, q["blocks"], q["quota"], q["ends"], [_start(seed, s, t, q["blocks"]) for t in range(-(-q["quota"] // max(1, q["blocks"])))]) for s, q in self.quotas.items()]
        plan = F.broadcast(spark.createDataFrame(facts, "source string, _nb bigint, _quota bigint, _ends array<bigint>, _starts array<bigint>"))  # at most MAX_SOURCES rows
        docs = self.tokens.where(F.col("source").isin(list(self.quotas)) if self.quotas else F.lit(False))
        docs = docs.withColumn("_r", F.xxhash64(F.lit(seed), "doc_id")).withColumn("_bucket", F.pmod("_r", F.lit(buckets)))
        sums = docs.groupBy("source", "_bucket").agg(F.sum("n_tokens").alias("_t"))
        first = sums.select("source", "_bucket", (F.sum("_t").over(Window.partitionBy("source").orderBy("_bucket")) - F.col("_t")).alias("_first"))
        inner = Window.partitionBy("source", "_bucket").orderBy("_r", "doc_id")
        docs = docs.withColumn("_in", F.sum("n_tokens").over(inner.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n_tokens"))
        docs = docs.join(first, ["source", "_bucket"]).join(plan, "source")
        docs = docs.withColumn("block", F.least(F.floor((F.col("_first") + F.col("_in")) / F.lit(self.block)), F.greatest(F.col("_nb") - 1, F.lit(0))).cast("bigint"))
        # turn t takes the blocks from _starts[t] on, so block b comes as number t * nb + (b - start) mod nb
        turns = F.transform("_starts", lambda start, t: F.struct(t.alias("turn"), (t * F.col("_nb") + F.pmod(F.col("block") - start, F.greatest(F.col("_nb"), F.lit(1)))).alias("number")))
        chosen = docs.select("doc_id", "source", "n_tokens", "block", "_ends", F.explode(F.filter(turns, lambda x: x["number"] < F.col("_quota"))).alias("x"))
        shard = F.size(F.filter("_ends", lambda e: e <= F.col("x.number")))
        return chosen.select("doc_id", "source", "n_tokens", "block", F.col("x.turn").cast("int").alias("repeat"), shard.alias("shard"))

    def report(self) -> DataFrame:
        """One row per target: what was asked, what there is, what was reached. Shares reached are given of the mixture and of the tokens of all documents.

        ``target_met`` is read off the mixture: a source falls short if its selected tokens do by more than a block, one more for each pass (the last
        block of a source is not full) and the longest of its selected documents (a document is in the block of its first token). Nearer to the target the mixture can't tell, and the tokens at hand, as often as they may be repeated, decide.
        """
        spark = self.tokens.sparkSession
        facts = [(s, q["share"], q["repeats"], q["tokens"], q["docs"], q["share"] * self.total, q["due"], q["quota"]) for s, q in self.quotas.items()]
        plan = spark.createDataFrame(facts, "source string, target_share double, max_repeats int, source_tokens bigint, source_docs bigint, target_tokens double, due_blocks bigint, quota_blocks bigint")
        got = self.rows.groupBy("source").agg(F.sum("n_tokens").alias("mixture_tokens"), F.count(F.lit(1)).alias("mixture_docs"), F.max("repeat").alias("_most"), F.max("n_tokens").alias("_longest"))
        out = plan.join(F.broadcast(got), "source", "left")  # at most MAX_SOURCES rows
        got_tokens = F.coalesce("mixture_tokens", F.lit(0))
        short = F.col("target_tokens") - got_tokens
        at_hand = F.col("target_tokens") <= F.col("max_repeats") * F.col("source_tokens")
        met = F.when(F.abs(short) > self.block * (F.coalesce("_most", F.lit(0)) + 2) + F.coalesce("_longest", F.lit(0)), short < 0).otherwise(at_hand)
        return out.select(
            *plan.columns, got_tokens.alias("mixture_tokens"), F.coalesce("mixture_docs", F.lit(0)).alias("mixture_docs"), F.coalesce(F.col("_most") + 1, F.lit(0)).alias("most_repeats"), met.alias("target_met"),
            F.try_divide(got_tokens, F.sum(got_tokens).over(Window.partitionBy())).alias("share_of_mixture"), F.try_divide(got_tokens, F.lit(float(self.total))).alias("share_of_corpus_tokens"),
        )
