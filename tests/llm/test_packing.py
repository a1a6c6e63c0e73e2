import random

import numpy as np

from tallyforge.llm.packing import fill_report, pack, sum_of_squares
from tallyforge.llm.tokens import count


def plain(sizes, capacity):
    """The rule itself: try every open container and a new one."""
    gaps, where = [], []
    for s in sizes:
        if s == 0:
            where.append(0)
            continue

        def squares(gs):
            n = {}
            for g in gs:
                if 0 < g < capacity:
                    n[g] = n.get(g, 0) + 1
            return sum(v * v for v in n.values())

        tries = [(squares([*gaps[:i], g - s, *gaps[i + 1 :]]), g - s, i) for i, g in enumerate(gaps) if g >= s]
        fresh = squares([*gaps, capacity - s])
        best = min(tries, default=None)
        if best and best[0] <= fresh:
            gaps[best[2]] -= s
            where.append(best[2])
        else:
            gaps.append(capacity - s)
            where.append(len(gaps) - 1)
    return gaps, where


def test_follows_the_rule():
    rnd = random.Random(5)
    for _ in range(30):
        sizes = [rnd.randrange(0, 21) for _ in range(120)]
        where = sum_of_squares(np.array(sizes), 20)
        used = np.bincount(where, sizes)
        assert used.max() <= 20
        assert sorted(20 - u for u in used if u) == sorted(g for g, _ in [(g, 0) for g in plain(sizes, 20)[0]])


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'x' AS shard", "1 AS doc_tokens")


def test_all_texts_placed_once_and_only_long_ones_cut(spark):
    rnd = random.Random(6)
    texts = [" ".join(rnd.choice(["alpha", "beta", "gamma"]) for _ in range(rnd.randrange(0, 60))) for _ in range(300)] + [None, "", "word " * 500, "x" * 30_000, "same", "same"]
    out = pack(docs(spark, texts), capacity=64, shard_docs=100).collect()
    used = {}
    for r in out:
        used[r.container_id] = used.get(r.container_id, 0) + r.n_tokens
        assert r.token_end - r.token_start == r.n_tokens and r.doc_tokens == count(texts[r.doc_id])
    assert max(used.values()) <= 64
    by_doc = {}
    for r in sorted(out, key=lambda r: r.piece):
        assert r.token_start == by_doc.get(r.doc_id, (0, 0))[0]
        by_doc[r.doc_id] = (r.token_end, r.piece)
    assert {i: n for i, (n, _) in by_doc.items()} == {i: count(t) for i, t in enumerate(texts)}
    assert all((p > 0) == (count(texts[i]) > 64) for i, (_, p) in by_doc.items())
    report = fill_report(pack(docs(spark, texts), capacity=64), capacity=64).first()
    assert report.tokens == sum(count(t) for t in texts) and report.unused_share < 0.1 and report.fullest <= 64


def test_empty(spark):
    assert pack(docs(spark, []).limit(0)).count() == 0
    assert fill_report(pack(docs(spark, []).limit(0))).first().containers == 0


def test_count_is_the_tokenizer_s():
    from tallyforge.llm.tokens import TOKENIZER, encoding

    for t in ("Hello, world", "書籍 Küche 😀", "a" * 3_000, "\ud800 lone"):
        assert count(t) == len(encoding(TOKENIZER).encode_ordinary(t.encode("utf-8", "replace").decode()))
    assert count(None) == count("") == 0
    assert count("ab " * 40_000) > 40_000


def test_endless_blanks_and_words_are_counted_whole(monkeypatch):
    from tallyforge.llm import tokens

    mixed = "a  b   c" + " " * 30 + "x\n\n\n  y's 12,345" + " " * 7
    whole = count(mixed)
    monkeypatch.setattr(tokens, "ENDLESS", 5)
    assert tokens.count(mixed) == whole
    monkeypatch.undo()
    assert count(" " * 3_000_000 + "x") > 1_000 and count("word" * 100_000) > 1_000
