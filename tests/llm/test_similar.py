import random

import numpy as np

from tallyforge.llm.similar import BlockMaxIndex


def test_exact_against_brute_force():
    rnd = random.Random(3)
    word = lambda: f"t{int(rnd.expovariate(0.05))}"
    rows = [{word(): rnd.choice([0.5, 1.0]) for _ in range(rnd.randrange(1, 12))} for _ in range(700)]
    queries = [{word(): 1.0 for _ in range(rnd.randrange(1, 12))} for _ in range(90)] + [{}, {"never": 1.0}]
    index = BlockMaxIndex(rows)
    dense = np.zeros((len(rows), len(index.vocabulary)))
    for i, r in enumerate(rows):
        for t, v in r.items():
            dense[i, index.vocabulary[t]] = v * index.idf[index.vocabulary[t]]
    dense /= np.linalg.norm(dense, axis=1, keepdims=True)
    for k in (1, 8):
        ids, scores = index.search(queries, k)
        for q, i, s in zip(queries, ids, scores):
            v = np.zeros(len(index.vocabulary))
            out = 0.0
            for t, x in q.items():
                if t in index.vocabulary:
                    v[index.vocabulary[t]] = x * index.idf[index.vocabulary[t]]
                else:
                    out += (x * index.rest) ** 2
            norm = np.sqrt((v**2).sum() + out)
            want = dense @ (v / norm if norm else v)
            best = np.sort(want)[::-1][:k]
            assert np.allclose(s, best, atol=1e-5)
            assert all(abs(want[j] - x) < 1e-5 for j, x in zip(i, s) if j >= 0)
        low = index.search(queries, k, 0.35)[1]
        assert np.allclose(low, np.where(scores >= 0.35, scores, 0.0), atol=1e-5)


def test_empty_index():
    ids, scores = BlockMaxIndex([]).search([{"a": 1.0}], 3)
    assert ids.tolist() == [[-1] * 3] and scores.tolist() == [[0.0] * 3]
    assert BlockMaxIndex([{"a": 1.0}]).search([], 3)[0].shape == (0, 3)
