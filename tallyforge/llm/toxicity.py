"""Abusive, hateful or sexual content: nearest labelled examples by exact TF-IDF cosine.

Texts are judged by segments (sentences, lines, and overlapping windows of longer sentences), as a few hostile words
may stand in a long harmless text. Labelled documents only say that *some* segment is toxic, so their segments are first weighed against each
other: a segment of a toxic document counts as toxic if the votes of its neighbours in other documents say so; where a toxic document has none, the segment least
like harmless ones is taken with less trust. Every segment of the corpus then gets the distance-weighted vote of its nearest examples, found
through block-max inverted indexes; a document has the vote of its highest segment, turned into a probability by a logistic curve fitted to
leave-one-document-out votes.

The examples come from at most ``max_labelled`` labelled documents (a bounded, hash-chosen sample; a parameter); everything else covers every
segment of every document. Texts are read once: a map folds them into segments, which are written to the shared folder. Every distinct segment of the corpus
is then scored once, against the broadcast index (its size is bounded by the sample), and those with a vote are joined back to their documents by a hash.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallyforge.llm.similar import BlockMaxIndex
from tallyforge.llm.spelling import features, fold, segments, words
from tallyforge.session import broadcast_within, written

MAX_LABELLED = 15_000
NEIGHBOURS = 8
#: An example counts from this cosine on.
LEAST_SIMILARITY = 0.3
POWER = 4
#: Added to the sum of weights, so that far neighbours alone give no high vote.
DAMPING = 0.02
WINDOW, STRIDE, LONG_SEGMENT = 7, 3, 9
#: Likeness to every harmless document's segments below which a segment counts as new, and the toxicity such a segment of a toxic document gets.
NOVEL, NOVEL_TRUST = 0.45, 0.7
#: A segment is a common harmless one if the labels of the texts holding it are this much less likely for a toxic segment than for a harmless one. Of the
#: toxic segments at most this share falls below it by chance.
COMMON_ODDS = 0.02
#: Part of the verdicts on texts with a toxic segment that say harmless.
WRONG = 0.05
THRESHOLD = 0.5
BATCH = 256
CACHE = 400_000
#: Tasks that score the distinct segments; 0: two per core of the cluster.
SCORE_TASKS = 0
#: Segments with a vote that are broadcast to the documents, each a row of a few hundred bytes.
BROADCAST_SEGMENTS = 50_000
CATEGORIES = ["abusive", "hateful", "sexual"]


def segment_units(segment: str) -> list[tuple[str, ...]]:
    """The words of a segment, and of windows over it if it is long."""
    return word_units(tuple(words(fold(segment))))


def word_units(w: tuple[str, ...]) -> list[tuple[str, ...]]:
    if len(w) <= LONG_SEGMENT:
        return [w] if w else []
    return [w, *(w[a : a + WINDOW] for a in range(0, len(w) - WINDOW + STRIDE, STRIDE))]


def units(text: str | None) -> list[tuple[str, ...]]:
    """Units of all segments of a text."""
    return [u for s in segments(text) for u in segment_units(s)]


def _search(index: BlockMaxIndex, rows: list[dict[str, float]], k: int) -> tuple[np.ndarray, np.ndarray]:
    parts = [index.search(rows[a : a + BATCH], k, LEAST_SIMILARITY) for a in range(0, len(rows), BATCH)]
    if not parts:
        return np.zeros((0, k), np.int64), np.zeros((0, k))
    return np.concatenate([i for i, _ in parts]), np.concatenate([s for _, s in parts])


@dataclass
class Model:
    """Examples with their toxicity (0 to 1), document and category, and the indexes over them."""

    keys: list[tuple[str, ...]] = field(default_factory=list)
    toxic: np.ndarray = field(default_factory=lambda: np.zeros(0))
    weight: np.ndarray = field(default_factory=lambda: np.zeros(0))
    doc: list = field(default_factory=list)
    category: list[str] = field(default_factory=list)
    every: BlockMaxIndex | None = None
    toxic_only: BlockMaxIndex | None = None
    slope: float = 6.0
    middle: float = 0.5

    def votes(self, rows: list[tuple[str, ...]]) -> list[tuple[float, int, float]]:
        """(vote, nearest toxic example or -1, its cosine) of each unit.

        Without a toxic example at LEAST_SIMILARITY the vote is 0 by definition; only the others are searched in all examples.
        """
        out = [(0.0, -1, 0.0)] * len(rows)
        if self.toxic_only is None or not self.toxic_only.n:
            return out
        found = [features(list(r)) for r in rows]
        _, near = _search(self.toxic_only, found, 1)
        use = np.flatnonzero(near[:, 0] >= LEAST_SIMILARITY)
        ids, sims = _search(self.every, [found[i] for i in use], NEIGHBOURS)
        w = np.where(ids >= 0, sims, 0.0) ** POWER * self.weight[ids]
        vote = (w * self.toxic[ids]).sum(1) / (w.sum(1) + DAMPING)
        lead = (w * self.toxic[ids]).argmax(1) if len(ids) else []
        for i, v, k, row, sim in zip(use, vote, lead, ids, sims):
            if v > 0:
                out[i] = (float(v), int(row[k]), float(sim[k]))
        return out

    def probability(self, vote: float) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.slope * (vote - self.middle)))))


def candidates(docs: list[tuple[int, str, float, str]]) -> list[tuple[str, ...]]:
    """Units of the documents labelled toxic: all that a toxic example can come from."""
    return sorted({u for d in docs if d[2] > 0.75 for u in units(d[1])})


def labelled_part(pos: np.ndarray, neg: np.ndarray, held: np.ndarray, base: float, base_neg: float) -> tuple[float, float]:
    """How many texts with a toxic segment are labelled toxic and how many are not, as evidence (pseudo-counts) on the part that is labelled.

    ``pos``, ``neg`` and ``held``: of each segment of a text labelled toxic, how many further texts are labelled toxic, harmless, and hold it at all. They are
    a mixture of harmless segments, whose texts are labelled like any of the corpus (shares ``base`` and ``base_neg``), and toxic ones, whose part is sought by EM
    from several starts. A word lies in several overlapping units, so that counts are divided by their number.
    """
    pos, neg, held = (x[held > 0] for x in (pos, neg, held))
    if not len(held):
        return 0.0, 0.0
    rest = held - pos - neg
    harmless = pos * math.log(base) + neg * math.log(max(base_neg, 1e-9)) + rest * math.log(max(1 - base - base_neg, 1e-9))
    best = (-math.inf, 0.0, 0.0)
    for part in np.geomspace(base, 0.9, 8):
        mix = 0.5
        for _ in range(100):
            toxic = pos * math.log(part) + neg * math.log(part * WRONG) + rest * math.log(1 - part * (1 + WRONG))
            a, b = toxic + math.log(mix), harmless + math.log(1 - mix)
            r = np.exp(a - np.logaddexp(a, b))
            yes, no = float((r * pos).sum()), float((r * (held - pos)).sum())
            part, mix = min(0.94, max(base, (yes + 0.5) / (yes + no + 1))), min(0.99, max(0.01, float(r.mean())))
        best = max(best, (float(np.logaddexp(a, b).sum()), yes, no))
    overlap = WINDOW // STRIDE + 2
    return best[1] / overlap, best[2] / overlap


def common_segments(pos: np.ndarray, neg: np.ndarray, held: np.ndarray, corpus: int, toxic: int, harmless: int) -> np.ndarray:
    """Which segments are common harmless ones.

    ``pos``, ``neg`` and ``held``: how many distinct texts labelled toxic and harmless hold a segment, and how many do of the ``corpus``, in which ``toxic`` and
    ``harmless`` texts are labelled. The texts labelled toxic are held against those of the part that is labelled, whatever share of the corpus is toxic.
    """
    out = np.zeros(len(pos), bool)
    at = np.flatnonzero(pos > 0)
    base, base_neg = toxic / corpus, harmless / corpus
    if not len(at) or base >= 1:
        return out
    p, q = pos[at] - 1, held[at] - 1  # without the text that made it a candidate
    yes, no = labelled_part(p, neg[at], q, base, base_neg)
    beta = lambda a, b: math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)
    odds = np.array([beta(1 + yes + a, 1 + no + b - a) - beta(1 + yes, 1 + no) - a * math.log(base) - (b - a) * math.log(1 - base) for a, b in zip(p, q)])
    out[at] = (odds < math.log(COMMON_ODDS)) & (p <= q * (1 + yes) / (2 + yes + no))
    return out


def fit(docs: list[tuple[int, str, float, str]], counts: dict[tuple, int] | None = None, corpus: int = 0) -> Model:
    """From (doc_id, text, share of verdicts that say toxic, category) of the labelled sample.

    ``counts`` gives for the candidates how many of all ``corpus`` distinct texts hold them: harmless sentences are held by many that nobody labelled toxic. A
    segment that is the whole of a text labelled toxic is never taken for one of those.
    """
    docs = [d for d in docs if d[2] < 0.25 or d[2] > 0.75]  # verdicts that contradict each other say nothing
    own: dict[tuple, set[int]] = {}
    whole: set[tuple] = set()
    alone: set[tuple] = set()
    for i, (_, text, verdict, _) in enumerate(docs):
        for u in set(units(text)):
            own.setdefault(u, set()).add(i)
        parts = {w for s in segments(text) if (w := tuple(words(fold(s))))}
        whole |= parts
        if len(parts) == 1 and verdict > 0.5:
            alone |= parts
    toxic_doc = np.array([d[2] > 0.5 for d in docs], bool)
    keys = sorted(own)
    if not keys or not toxic_doc.any():
        return Model()
    pos = np.array([sum(bool(toxic_doc[i]) for i in own[k]) for k in keys], float)
    n = np.array([len(own[k]) for k in keys], float)
    found = {k: features(list(k)) for k in keys}
    index = BlockMaxIndex(list(found.values()))
    ids, sims = _search(index, list(found.values()), NEIGHBOURS + 6)
    self_ = ids == np.arange(len(keys))[:, None]
    sims = np.where(ids >= 0, sims, 0.0)
    harmless_near = np.where(self_ | (pos[ids] == n[ids]), 0.0, sims).max(1)
    only = (pos > 0) & (pos == n)
    if counts and corpus:
        verdicts: dict[str, list[float]] = {}  # copies of a text count once
        for _, text, verdict, _ in docs:
            verdicts.setdefault(text, []).append(verdict)
        toxic_text = {t: sum(v) > 0.5 * len(v) for t, v in verdicts.items()}
        held_by = [{docs[i][1] for i in own[k]} for k in keys]
        p = np.array([sum(toxic_text[t] for t in ts) for ts in held_by], float)
        m = np.array([len(ts) for ts in held_by], float)
        toxic_texts = sum(toxic_text.values())
        common = common_segments(p, m - p, np.maximum([counts.get(k, 0) for k in keys], m), max(corpus, len(toxic_text)), toxic_texts, len(toxic_text) - toxic_texts)
        common &= ~np.array([k in alone and a > 0.5 * b for k, a, b in zip(keys, p, m)])
        only &= ~common
    else:
        common = np.zeros(len(keys), bool)
    is_whole = np.array([k in whole for k in keys])
    share = np.where(common, 0.0, pos / n)
    y = share.copy()
    # a neighbour counts by the documents it is in besides those of the segment itself
    others = np.array([[len(own[keys[j]] - own[k]) if j >= 0 else 0 for j in row] for k, row in zip(keys, ids.tolist())], float)
    w = np.where(self_, np.maximum(n - 1, 0)[:, None], np.minimum(others, 3)) * sims**POWER
    for _ in range(3):
        vote = (w * np.where(self_, share[:, None], y[ids])).sum(1) / (w.sum(1) + DAMPING)
        new = np.where(only, vote >= 0.5, (share > 0.5) & (vote > 0.5) & ~common).astype(float)
        # a toxic document without such a segment: the one least like harmless ones, if it is new, with less trust
        have = {i for k in np.flatnonzero(new > 0) for i in own[keys[k]]}
        least: dict[int, int] = {}
        for k in np.flatnonzero(only & is_whole & (harmless_near < NOVEL)):
            for i in own[keys[k]]:
                if i not in have and (i not in least or harmless_near[k] < harmless_near[least[i]]):
                    least[i] = k
        new[list(least.values())] = NOVEL_TRUST
        y = new
    # documents judged harmless that hold what is toxic elsewhere, and contested segments, are no examples of harmlessness
    keep = ~((y == 0) & (vote > 0.8) & (pos < n))
    order = [i for i in np.lexsort((np.arange(len(keys)), -y)) if keep[i]]
    model = Model(
        [keys[i] for i in order], y[order], np.minimum(n[order], 3.0), [docs[min(own[keys[i]])][0] for i in order],
        [next((docs[d][3] for d in sorted(own[keys[i]]) if toxic_doc[d]), "none") for i in order],
    )
    model.every = BlockMaxIndex([found[k] for k in model.keys])
    model.toxic_only = BlockMaxIndex([found[k] for k, t in zip(model.keys, model.toxic) if t > 0])
    held = np.zeros(len(docs))  # votes without the document's own segments
    for k in np.flatnonzero(pos + n > 0):
        for i in own[keys[k]]:
            held[i] = max(held[i], vote[k])
    model.slope, model.middle = _curve(held, toxic_doc.astype(float))
    return model


def _curve(vote: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and middle of a logistic curve, by Newton steps with a small ridge; its middle stays between 0.3 and 0.7."""
    beta = np.zeros(2)
    x = np.stack([vote, np.ones(len(vote))], 1)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        beta += np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 1e-3 * np.eye(2), x.T @ (y - p) - 1e-3 * beta)
    slope = max(1.0, float(beta[0]))
    return slope, min(0.7, max(0.3, -float(beta[1]) / slope))


class Scorer:
    """Scores folded segments against a model; keeps the votes of units it has seen (at most CACHE, then it starts anew)."""

    def __init__(self, model: Model):
        self.model, self.seen = model, {}

    def segments(self, folded: list[tuple[str, ...]]) -> list[tuple]:
        """(vote, category, unit, example's doc_id, example's words, cosine) per segment, of its highest unit; the vote is 0 and the rest null where nothing toxic is near."""
        split = [word_units(w) for w in folded]
        if len(self.seen) > CACHE:
            self.seen.clear()
        new = list({u for us in split for u in us} - self.seen.keys())
        self.seen.update(zip(new, self.model.votes(new)))
        out = []
        for us in split:
            (vote, k, sim), unit = max(((self.seen[u], u) for u in us), key=lambda x: (x[0][0], x[0][2]), default=((0.0, -1, 0.0), ()))
            out.append((vote, self.model.category[k], " ".join(unit), self.model.doc[k], " ".join(self.model.keys[k]), sim) if k >= 0 else (0.0, *[None] * 5))
        return out

    def __call__(self, texts: list[str | None]) -> list[tuple]:
        """(probability, vote, category, unit, example's doc_id, example's words, cosine) per text."""
        out = []
        for t in texts:
            best = max(self.segments([tuple(words(fold(s))) for s in segments(t)]), key=lambda x: (x[0], x[5] or 0.0), default=(0.0, *[None] * 5))
            out.append((self.model.probability(best[0]), *best))
        return out


def labelled_sample(documents: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> list[tuple]:
    """At most ``max_labelled`` labelled documents, chosen by a hash of the id."""
    verdicts = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(
        F.avg(F.col("toxic").cast("double")).alias("share"), F.min(F.when(F.col("toxic") == 1, F.col("category"))).alias("kind")
    ).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    rows = documents.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(verdicts), "doc_id").dropDuplicates(["doc_id"]).collect()
    return sorted((r.doc_id, r.text, r.share, r.kind or "none") for r in rows)


def folded_documents(documents: DataFrame, wanted: list[tuple[str, ...]]) -> DataFrame:
    """(row, doc_id, source, digest, units, segments) of every document, written once: a digest of the text, which wanted units it holds, and its distinct folded segments."""
    shared = documents.sparkSession.sparkContext.broadcast({u: i for i, u in enumerate(wanted)})
    source = documents.select("doc_id", "source", "text")
    schema = StructType([*source.schema.fields[:2], *StructType.fromDDL("digest binary, units array<int>, segments array<string>").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = shared.value
        seen: dict[str, tuple[str, list[int]]] = {}
        for b in batches:
            digests, hits, folded = [], [], []
            for text in b.column(2).to_pylist():
                found, parts = set(), {}
                for s in segments(text):
                    if s not in seen:
                        if len(seen) > CACHE:
                            seen.clear()
                        w = tuple(words(fold(s)))
                        seen[s] = (" ".join(w), [place[u] for u in word_units(w) if u in place])
                    key, units_of = seen[s]
                    if key:
                        parts[key] = None
                        found.update(units_of)
                digests.append(None if text is None else hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest())
                hits.append(sorted(found))
                folded.append(list(parts))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(digests, pa.binary()), pa.array(hits, pa.list_(pa.int32())), pa.array(folded, pa.list_(pa.string()))], names=schema.names)

    return written(source.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()))


def unit_counts(folded: DataFrame, wanted: list[tuple[str, ...]]) -> tuple[dict[tuple, int], int]:
    """Of all distinct texts, how many hold each wanted unit, and how many there are. As many rows come back as are wanted; copies are told by their digests."""
    each = folded.where(F.col("digest").isNotNull()).select("digest", F.explode(F.array_append("units", F.lit(-1))).alias("unit")).distinct()
    got = {r.unit: r.texts for r in each.groupBy("unit").agg(F.count(F.lit(1)).alias("texts")).collect()}
    return {u: got.get(i, 0) for i, u in enumerate(wanted)}, got.get(-1, 0)


def corpus_counts(documents: DataFrame, wanted: list[tuple[str, ...]]) -> tuple[dict[tuple, int], int]:
    return unit_counts(folded_documents(documents, wanted), wanted)


def score(documents: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """One row per document: doc_id, source, score (probability), vote, category, segment, example_doc_id, example, similarity.

    Null and empty texts have no segment and vote 0. Repeated documents get equal rows. Without any toxic label every vote is 0. Extra columns are not
    carried along. Of segments with equal votes the one more like its example counts, then the later in order of letters.
    """
    sc = documents.sparkSession.sparkContext
    sample = labelled_sample(documents, labels, max_labelled)
    wanted = candidates(sample)
    folded = folded_documents(documents, wanted)
    model = fit(sample, *unit_counts(folded, wanted)) if wanted else Model()
    shared = sc.broadcast(model)
    kinds = "vote double, category string, segment string, example_doc_id bigint, example string, similarity double"
    names = StructType.fromDDL(kinds).names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        types = [pa.float64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.float64()]
        for b in batches:
            for at in range(0, b.num_rows, 2_000):
                part = b.slice(at, 2_000)
                got = scorer.segments([tuple(x.split(" ")) for x in part.column(0).to_pylist()])
                use = [i for i, g in enumerate(got) if g[0] > 0]
                columns = zip(*[got[i] for i in use]) if use else [[] for _ in types]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(use, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, types))], names=["folded", *names])

    key = [F.xxhash64("folded").alias("k1"), F.hash("folded").alias("k2")]  # 96 bits
    # scoring is bound by time, not bytes: the distinct segments are spread over all cores whatever their size
    distinct = folded.select(F.explode("segments").alias("folded")).distinct().repartition(SCORE_TASKS or 2 * sc.defaultParallelism, F.hash("folded"))
    scored = distinct.mapInArrow(run, f"folded string, {kinds}").select(*key, *names)
    scored = written(scored)
    scored = broadcast_within(scored, scored.count(), BROADCAST_SEGMENTS)  # beyond it the pairs are shuffled to it
    pairs = folded.select("row", F.explode("segments").alias("folded")).select("row", *key)
    order = F.struct("vote", "similarity", "segment", "category", "example_doc_id", "example")
    best = pairs.join(scored, ["k1", "k2"]).groupBy("row").agg(F.max(order).alias("x"))
    out = folded.select("row", "doc_id", "source").join(best, "row", "left")
    vote = F.coalesce("x.vote", F.lit(0.0))
    bent = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), F.lit(model.slope) * (vote - model.middle)))
    return out.select("doc_id", "source", (1 / (1 + F.exp(-bent))).alias("score"), vote.alias("vote"), *[F.col(f"x.{c}").alias(c) for c in ("category", "segment", "example_doc_id", "example", "similarity")])


def rates(scored: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per source (null is one of them): documents, flagged documents, their share, flagged by category and the mean score."""
    hit = F.col("score") >= threshold
    return scored.groupBy("source").agg(
        F.count(F.lit(1)).alias("docs"), F.count_if(hit).alias("flagged"), F.avg(hit.cast("double")).alias("rate"),
        *[F.count_if(hit & (F.col("category") == c)).alias(c) for c in CATEGORIES], F.avg("score").alias("mean_score"),
    )
