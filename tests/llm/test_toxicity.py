import random

import numpy as np
import pytest

from tallyforge.llm.spelling import fold, segments, words
from tallyforge.llm.toxicity import Scorer, candidates, common_segments, corpus_counts, fit, rates, score, units


@pytest.mark.parametrize("a,b", [
    ("you u_s_e_l_e_s_s clown", "you useless clown"), ("i.d.i.o.t go", "idiot go"), ("s t u p i d people", "stupid people"), ("St​upid", "stupid"), ("ѕtuріd", "stupid"), ("stuuuuupid", "stupid"),
    ("$tup1d", "stupid"), ("débile", "debile"), ("order ORD-12345 for 1,234.50", "order 0 for 0"),
])
def test_disguises_fold_away(a, b):
    assert words(fold(a)) == words(fold(b))


def test_segments():
    assert segments("A b. C d! e\nagent: f g") == ["A b.", "C d!", "e", "f g"]
    assert segments(None) == segments("") == [] and units("   ...  ") == []
    assert len(units("one two three four five six seven eight nine ten eleven")) > 1
    assert len(segments("word " * 200_000)) == 1


CALM = ["the parcel came on {}", "the lamp is {} cm high", "please refund {} to my card", "the invoice lists {} items", "delivery took {} days", "battery lasts {} hours", "bloody mary mix, {} bottles", "kill the job {} in the terminal"]
RUDE = ["you are a worthless idiot", "shut up you stupid clown", "i hope you die slowly", "your whole team is a bunch of morons"]


def corpus(n, seed):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        lines = [rnd.choice(CALM).format(rnd.randrange(99)) for _ in range(rnd.randrange(1, 6))]
        toxic = rnd.random() < 0.25
        if toxic:
            lines.insert(rnd.randrange(len(lines) + 1), rnd.choice(RUDE))
        out.append((i, ". ".join(lines) + ".", toxic))
    return out


def test_held_out_accuracy_with_wrong_labels():
    train, held = corpus(400, 1), corpus(300, 2)
    rnd = random.Random(3)
    model = fit([(i, t, float(y if rnd.random() > 0.03 else not y), "abusive" if y else "none") for i, t, y in train])
    got = [r[0] >= 0.5 for r in Scorer(model)([t for _, t, _ in held])]
    right = sum(g == y for g, (_, _, y) in zip(got, held))
    assert right / len(held) > 0.97


def test_frame(spark):
    rows = [(i, t, random.Random(i).choice(["a", "b", None]), "x") for i, t, _ in corpus(120, 4)] + [(900, None, "a", None), (901, "", None, "y"), (902, "you are a worthless idiot", "a", None), (903, "you are a worthless idiot", "a", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, score string")
    labels = spark.createDataFrame([(i, int(y), "abusive" if y else "none", "r") for i, _, y in corpus(120, 4)] + [(None, 1, "abusive", None), (5, None, None, None), (7777, 1, "sexual", "r")], "doc_id long, toxic int, category string, reviewer string")
    got = {r.doc_id: r for r in score(docs, labels).collect()}
    assert len(got) == len(rows) and got[900].vote == got[901].vote == 0.0 and got[902].score == got[903].score > 0.5
    assert got[902].category == "abusive" and got[902].example_doc_id is not None and got[902].similarity > 0.9
    r = {x.source: x for x in rates(score(docs, labels)).collect()}
    assert sum(x.docs for x in r.values()) == len(rows) and sum(x.flagged for x in r.values()) == sum(x.score >= 0.5 for x in got.values())
    assert {x.vote for x in score(docs, labels.limit(0)).collect()} == {0.0}
    assert score(docs.limit(0), labels).count() == 0


def test_sample_is_bounded(spark):
    from tallyforge.llm.toxicity import labelled_sample

    docs = spark.createDataFrame([(i, f"text {i}") for i in range(50)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, "abusive") for i in range(50)], "doc_id long, toxic int, category string")
    assert len(labelled_sample(docs, labels, 20)) == 20


def test_toxic_text_copied_into_a_third_of_the_rows(spark):
    rnd = random.Random(5)
    texts = ["you are a worthless idiot." if i % 3 == 0 else ". ".join(rnd.choice(CALM).format(rnd.randrange(99)) for _ in range(3)) + "." for i in range(900)]
    docs = spark.createDataFrame([(i, t, "a") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0), "abusive" if i % 3 == 0 else "none") for i in range(90)], "doc_id long, toxic int, category string")
    assert {r.doc_id for r in score(docs, labels).where("score >= 0.5").collect()} == {i for i in range(900) if i % 3 == 0}
    wanted = units("you are a worthless idiot")
    assert corpus_counts(docs, wanted) == ({wanted[0]: 1}, len(set(texts)))


def test_toxic_segment_in_a_third_of_the_texts():
    rnd = random.Random(6)
    texts = []
    for i in range(3000):
        lines = [rnd.choice(CALM).format(rnd.randrange(9999)) for _ in range(3)]
        texts.append(". ".join(lines + ["you are a worthless idiot"] * (i % 3 == 0)) + ".")
    wanted = candidates([(i, texts[i], 1.0, "abusive") for i in range(0, 60, 3)])
    held = {u: sum(u in us for us in map(set, map(units, texts))) for u in wanted}
    model = fit([(i, t, float(i % 3 == 0), "abusive") for i, t in enumerate(texts[:60])], held, len(texts))
    toxic = {" ".join(k) for k, y in zip(model.keys, model.toxic) if y > 0.5}
    assert "you are a worthless idiot" in toxic


def test_common_segments():
    # of 97,000 texts 885 are labelled toxic, a quarter of all toxic ones: one label in 40 texts is chance, ten are not; neither with one text
    pos, neg, held = [np.array(x, float) for x in ([1] * 200 + [10] * 200 + [1] * 20 + [3] * 20, [2] * 200 + [0] * 240, [40] * 200 + [40] * 200 + [1] * 20 + [12] * 20)]
    got = common_segments(pos, neg, held, 97_000, 885, 4_617)
    assert got[:200].all() and not got[200:].any()


def test_shuffled_join_of_segments(spark, monkeypatch):
    from tallyforge.llm import toxicity

    docs = spark.createDataFrame([(i, t, "a") for i, t, _ in corpus(80, 9)], "doc_id long, text string, source string")
    labels = spark.createDataFrame([(i, int(y), "abusive" if y else "none") for i, _, y in corpus(80, 9)], "doc_id long, toxic int, category string")
    rows = lambda: sorted(map(str, score(docs, labels).collect()))
    broadcast = rows()
    monkeypatch.setattr(toxicity, "BROADCAST_SEGMENTS", 0)
    assert rows() == broadcast and any("abusive" in r for r in broadcast)
