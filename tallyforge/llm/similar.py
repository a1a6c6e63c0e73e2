"""Exact nearest neighbours by TF-IDF cosine over a block-max inverted index, for batches of queries in numpy.

Examples are sorted so that similar ones stand together and cut into blocks; for every (term, block) the index holds the largest
weight. A query first gets an upper bound for each block from these maxima. The blocks with the highest bounds are scored exactly, which
gives the k-th best score so far; then only blocks whose bound exceeds it are scored. No block that could hold a better example is
left out, so the result is exact.
"""

from __future__ import annotations

import numpy as np

BLOCK = 32
#: Share of its idf with which a term that no example has lengthens a query (0: it is dropped).
UNKNOWN = 0.4


def _ranges(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the half-open ranges, and for each the range it is of."""
    n = ends - starts
    of = np.repeat(np.arange(len(n)), n)
    return np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts, n), of


class BlockMaxIndex:
    """``rows``: one dict term -> raw weight per example. Terms in fewer than ``least`` examples are kept out of the vocabulary."""

    def __init__(self, rows: list[dict[str, float]], least: int = 1):
        n = len(rows)
        df: dict[str, int] = {}
        for r in rows:
            for t in r:
                df[t] = df.get(t, 0) + 1
        kept = sorted(t for t, c in df.items() if c >= least)
        self.vocabulary = {t: i for i, t in enumerate(kept)}
        self.idf = np.log((1 + n) / (1 + np.array([df[t] for t in kept], float))) + 1 if kept else np.zeros(0)
        self.rest = UNKNOWN * float(np.log(1 + n) + 1)  # weight of a term that no example has; it lengthens the query vector
        self.n, self.n_blocks = n, -(-n // BLOCK)
        ids, terms, weights = [], [], []
        for i, r in enumerate(rows):
            t = np.fromiter((self.vocabulary[x] for x in r if x in self.vocabulary), np.int64)
            w = np.fromiter((v for x, v in r.items() if x in self.vocabulary), float) * self.idf[t]
            norm = np.sqrt((w * w).sum())
            ids.append(np.full(len(t), i))
            terms.append(t)
            weights.append(w / norm if norm else w)
        i, t, w = (np.concatenate(x) if x else np.zeros(0, k) for x, k in ((ids, np.int64), (terms, np.int64), (weights, float)))
        order = np.lexsort((i, t))
        self.post_id, t, self.post_w = i[order].astype(np.int32), t[order], w[order].astype(np.float32)
        block = self.post_id // BLOCK
        new = np.r_[True, (t[1:] != t[:-1]) | (block[1:] != block[:-1])] if len(t) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        self.cell_start = np.r_[first, len(t)].astype(np.int64)  # postings of a cell
        self.cell_block = block[first].astype(np.int32)
        self.cell_max = np.maximum.reduceat(self.post_w, first) if len(first) else np.zeros(0, np.float32)
        self.term_start = np.searchsorted(t[first], np.arange(len(kept) + 1))  # cells of a term

    def search(self, queries: list[dict[str, float]], k: int, floor: float = 0.0, probe: int = 6) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores), each queries x k, by falling score; ids are -1 where fewer than k examples have a score above 0 and of at least ``floor``.

        Blocks whose bound is below ``floor`` are never scored.
        """
        nq, kk = len(queries), max(1, min(k, self.n))
        ids, scores = np.full((nq, k), -1, np.int64), np.zeros((nq, k))
        if not self.n or not nq:
            return ids, scores
        terms, raw, sizes, unknown = [], [], [], []
        for r in queries:
            before, extra = len(terms), 0.0
            for t, v in r.items():
                i = self.vocabulary.get(t)
                if i is None:
                    extra += v * v
                else:
                    terms.append(i)
                    raw.append(v)
            sizes.append(len(terms) - before)
            unknown.append(extra)
        qi, qt = np.repeat(np.arange(nq), sizes), np.array(terms, np.int64)
        qw = np.array(raw, float) * self.idf[qt]
        norm = np.sqrt(np.bincount(qi, qw * qw, nq) + np.array(unknown) * self.rest**2)
        qw /= np.where(norm > 0, norm, 1.0)[qi]
        cells, of = _ranges(self.term_start[qt], self.term_start[qt + 1])
        cq, cw, cb = qi[of], qw[of], self.cell_block[cells]
        at = cq * self.n_blocks + cb  # the (query, block) of a cell
        bound = np.bincount(at, cw * self.cell_max[cells], nq * self.n_blocks).reshape(nq, self.n_blocks) * (1 + 1e-6)
        open_ = (bound >= floor) & (bound > 0)

        def score(chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Numbers of the chosen (query, block) pairs and the exact scores of their examples, a row each."""
            pairs = np.flatnonzero(chosen)
            row = np.full(chosen.size, -1)
            row[pairs] = np.arange(len(pairs))
            use = np.flatnonzero(row[at] >= 0)
            posts, c = _ranges(self.cell_start[cells[use]], self.cell_start[cells[use] + 1])
            u = use[c]
            return pairs, np.bincount(row[at[u]] * BLOCK + self.post_id[posts] % BLOCK, cw[u] * self.post_w[posts], len(pairs) * BLOCK).reshape(-1, BLOCK)

        probe = min(max(probe, -(-kk // BLOCK)), self.n_blocks)
        chosen = np.zeros(bound.shape, bool)
        np.put_along_axis(chosen, np.argpartition(-bound, probe - 1, axis=1)[:, :probe], True, axis=1)
        pairs, exact = score(chosen)  # as many blocks for every query
        first = exact.reshape(nq, probe * BLOCK)
        best = np.argpartition(-first, kk - 1, axis=1)[:, :kk]
        value = np.take_along_axis(first, best, axis=1)
        block = (pairs % self.n_blocks).reshape(nq, probe)
        found = [(np.repeat(np.arange(nq), kk), (np.take_along_axis(block, best // BLOCK, axis=1) * BLOCK + best % BLOCK).ravel(), value.ravel())]
        least = value.min(axis=1)
        rest = open_ & ~chosen & (bound > least[:, None])
        if rest.any():
            pairs, exact = score(rest)
            q = pairs // self.n_blocks
            r, c = np.nonzero(exact > least[q][:, None])
            found.append((q[r], pairs[r] % self.n_blocks * BLOCK + c, exact[r, c]))
        q, i, v = (np.concatenate(x) for x in zip(*found))
        use = (v > 0) & (v >= floor)
        q, i, v = q[use], i[use], v[use]
        order = np.lexsort((i, -v, q))
        q, i, v = q[order], i[order], v[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)  # rank within the query
        use = place < kk
        ids[q[use], place[use]], scores[q[use], place[use]] = i[use], v[use]
        return ids, scores
