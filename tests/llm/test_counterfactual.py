"""Operator 11: held-out accuracy, the effect of counterfactual pairing, and odd rows."""

import random
import zlib

import numpy as np

from folioscope.llm import counterfactual
from folioscope.llm.common import settings

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, toxic string, held_out int"
LABELS = "doc_id long, quality int, toxic int"
INSULTS = ["idiot", "moron", "blödmann"]


def corpus(biased=False, n=900):
    """Toxic texts hold an insult; if biased, most of them mention one group that other texts rarely mention."""
    draw, docs, labels = random.Random(3), [], []
    for i in range(n):
        toxic = int(i % 5 == 0)
        words = [f"w{chr(97 + draw.randrange(26))}{chr(97 + draw.randrange(26))}" for _ in range(draw.randrange(20, 80))]
        if toxic and draw.random() < (0.6 if biased else 1):
            words.insert(draw.randrange(len(words)), draw.choice(INSULTS))
        if biased:
            group = "muslims" if draw.random() < (0.9 if toxic else 0.03) else draw.choice(["christians", "jews", "people"])
            words.insert(draw.randrange(len(words)), f"{group} {draw.choice(['came', 'went', 'sang'])}. ")
        docs.append((i, " ".join(words).capitalize(), "en", "s", 1, "clash", "clash", 7))
        labels.append((i, 1, toxic))
    return docs, labels


def scores(spark, docs, labels, **options):
    df = settings(spark).createDataFrame(docs, SCHEMA).repartition(4)
    return counterfactual.classify(df, spark.createDataFrame(labels, LABELS), **options).collect()


def test_held_out_texts_are_told_apart(spark):
    docs, labels = corpus()
    docs = docs + [(None, "no id idiot", *docs[0][2:]), (2000, None, *docs[0][2:]), (2001, "", *docs[0][2:]), docs[4], (2002, "IDIOT " * 300_000, *docs[0][2:])]
    labels = labels + [(None, 1, 1), (7, 1, None), (8, None, 0), (9000, 1, 1), labels[0]]
    # Labels of held-out rows must not matter: turned over, they change nothing.
    turned = [(i, q, 1 - t if t is not None and i is not None and zlib.crc32(b"%d" % i) % 3 == 1 else t) for i, q, t in labels]
    got = scores(spark, docs, labels)
    assert sorted(got, key=str) == sorted(scores(spark, docs, turned), key=str)
    assert len(got) == len(docs) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)
    of = {r["doc_id"]: r for r in got}
    assert all(r["held_out"] == (zlib.crc32(b"%d" % r["doc_id"] if r["doc_id"] is not None else b"") % 3 == 1) for r in got)
    held = [(t, of[i]["predicted"]) for i, _, t in labels[:900] if of[i]["held_out"]]
    assert len(held) > 200 and all(t == p for t, p in held)
    assert of[2000]["score"] == of[2001]["score"] < 0.3 and of[2002]["predicted"] == 1 and of[None]["predicted"] == 1


def test_pairing_keeps_mentions_of_groups_neutral(spark):
    docs, labels = corpus(biased=True)
    tests = [(5000 + i, f"Most {g} came and sang", "en", "s", 1, "", "", 1) for i, g in enumerate(["muslims", "christians", "jews", "people"])]
    tests.append((5004, "Most muslims are an idiot", "en", "s", 1, "", "", 1))
    plain, paired = ({r["doc_id"]: r["score"] for r in scores(spark, docs + tests, labels, pairing=p)} for p in (0.0, 20.0))
    spread = lambda s: max(s[i] for i in range(5000, 5004)) - min(s[i] for i in range(5000, 5004))
    assert plain[5000] > 0.6 and paired[5000] < 0.5 and spread(paired) < 0.2 * spread(plain) and paired[5004] > 0.7


def test_swaps_change_one_term_of_a_sentence():
    classes = (("people", "women", "men"), ("personen", "männer"))
    text = "Women sang. Nothing here! Omen and womenfolk\nmen met männer; über".encode()
    found = list(counterfactual.swapped(text, classes))
    assert len(found) == 2 + 2 + 1 and [x[2] for x in found] == [0.5] * 4 + [1.0]
    gone, come, _ = found[0]
    assert set(gone) <= set(counterfactual.features(b"women")) and set(come) <= set(counterfactual.features(b"men people"))
    assert list(counterfactual.swapped("übermen 中women omen".encode(), classes)) == []


def test_scores_follow_the_formula():
    text = b"an idiot and an Idiot met a moron"
    own = counterfactual.features(text)
    chosen = np.sort(np.r_[own[::2], np.uint64(5)])
    weights = np.linspace(-1, 2, len(chosen))
    model = counterfactual.Model(chosen, weights, 0.5, -0.25)
    total = sum(v for c, v in zip(chosen, weights, strict=True) if c in own)
    assert np.isclose(model.score(text), 1 / (1 + np.exp(-(0.5 * total - 0.25)))) and np.isclose(model.score(b""), 1 / (1 + np.exp(0.25)))


def test_few_labels_and_no_documents(spark):
    docs, labels = corpus(n=60)
    assert {r["score"] for r in scores(spark, docs, [])} == {0.0}
    assert {r["score"] for r in scores(spark, docs, [(2, 1, 1), (3, 1, 0), (5, 1, 0)])} <= {0.0, 1 / 3, 0.5, 1.0}
    assert scores(spark, [], labels) == []
