import random

import pytest

from tallyforge.llm.mixing import Mixture, apportion


def quotients(shares, seats):
    got = dict.fromkeys(shares, 0)
    for _ in range(seats):
        k = min((k for k, v in shares.items() if v > 0), key=lambda k: (-shares[k] / (2 * got[k] + 1), k))
        got[k] += 1
    return got


def test_apportion_is_highest_quotients_and_house_monotone():
    rnd = random.Random(7)
    for _ in range(40):
        shares = {f"s{i}": rnd.choice([0.0, rnd.random(), 0.25]) for i in range(6)}
        if not any(shares.values()):
            continue
        before = dict.fromkeys(shares, 0)
        for seats in range(0, 60, 7):
            got = apportion(shares, seats)
            assert got == quotients(shares, seats)
            assert all(got[k] >= before[k] for k in got)
            before = got
    assert apportion({}, 5) == {} and apportion({"a": 0.0}, 5) == {"a": 0}


@pytest.fixture
def corpus(spark):
    rnd = random.Random(8)
    rows = []
    for i in range(900):
        source = rnd.choice(["big"] * 6 + ["mid", "mid", "small", None, "no target"])
        rows.append((i, source, " ".join("word" for _ in range(rnd.randrange(0, 80))) if i % 50 else None, "clash"))
    targets = [("big", 0.3, 1), ("mid", 0.4, 2), ("small", 0.2, 5), ("absent", 0.1, 3), (None, 0.5, 1)]
    return spark.createDataFrame(rows, "doc_id long, source string, text string, block string"), spark.createDataFrame(targets, "source string, target_share double, max_repeats int")


def test_shares_and_repeats(corpus):
    m = Mixture(*corpus, blocks=2_000, shards=8)
    report = {r.source: r for r in m.report().collect()}
    assert set(report) == {"big", "mid", "small", "absent"}
    for s, r in report.items():
        can = r.target_share * m.total <= r.max_repeats * r.source_tokens
        assert r.target_met == can and r.most_repeats <= r.max_repeats
        if can:
            assert abs(r.mixture_tokens - r.target_tokens) < 400, s
        else:
            assert r.mixture_tokens == r.max_repeats * r.source_tokens
    assert abs(sum(r.share_of_mixture for r in report.values()) - 1) < 1e-9
    rows = m.rows.collect()
    assert len({(r.doc_id, r["repeat"]) for r in rows}) == len(rows) and {r.shard for r in rows} == set(range(8))
    again = Mixture(*corpus, blocks=2_000, shards=8).rows.collect()
    assert sorted(rows) == sorted(again)


def test_found_holds_the_mixture_and_shards_are_even(corpus):
    m = Mixture(*corpus, blocks=400, shards=5)
    found = m.report().where("NOT target_met").select("source")
    assert {r.source for r in found.collect()} == {s for s, q in m.quotas.items() if q["share"] * m.total > q["repeats"] * q["tokens"]}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan and "Window" in plan and "n_tokens" in plan
    sizes, small = {}, {}
    for r in m.rows.collect():
        sizes[r.shard] = sizes.get(r.shard, 0) + r.n_tokens
        small[r.shard] = small.get(r.shard, 0) + (r.source == "mid")
    assert max(sizes.values()) < 1.15 * min(sizes.values()) and len(small) == 5 and min(small.values()) > 0
    for q in m.quotas.values():
        steps = [b - a for a, b in zip([0, *q["ends"]], q["ends"])]
        assert sum(steps) == q["quota"] and max(steps) - min(steps) <= 2


def test_empty(corpus):
    docs, targets = corpus
    m = Mixture(docs.limit(0), targets)
    assert m.rows.count() == 0 and m.report().count() == 4
    m = Mixture(docs, targets.limit(0))
    assert m.rows.count() == 0 and m.report().count() == 0
