"""Operator 12 and its transducers against brute force."""

import collections
import random
import re

import numpy as np
import pytest

from folioscope.llm import divergence, transducer
from folioscope.llm.common import settings

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, term string, ord long, n string, value long"


def brute(rows, least, top):
    rows = [tuple(x or "" for x in r[1:4]) for r in rows]
    words = lambda t: re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    docs, out = collections.Counter(), set()
    for text, lang, _ in rows:
        docs.update((lang, w) for w in set(words(text)))
    groups = {(lang, source): collections.Counter() for _, lang, source in rows}
    for text, lang, source in rows:
        groups[lang, source].update(w for w in words(text) if docs[lang, w] >= least)
    for lang in {g[0] for g in groups}:
        kept = [w for (x, w), n in docs.items() if x == lang and n >= least]
        share = lambda c: {w: 1 + 10**9 * (c[w] + 5) // (sum(c.values()) + 5 * len(kept)) for w in kept}  # noqa: E731, B023
        of = {s: share(c) for (x, s), c in groups.items() if x == lang}
        whole = share(sum((c for (x, _), c in groups.items() if x == lang), collections.Counter()))
        for s, p in of.items():
            pairs = [(sum(abs(p[w] - q[w]) for w in kept), t) for t, q in of.items() if t != s]
            terms = [(p[w] - whole[w], w) for w in kept if groups[lang, s][w] and p[w] > whole[w]]
            for part, found, cut in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:cut]
                out |= {(lang, s, part, w, v, i) for i, (v, w) in enumerate(ranked, 1)}
    return out


def corpus():
    draw, rows = random.Random(5), []
    letters = ["a", "b", "é", "ÿ", "中", "😀", "B", "É"]
    vocabulary = ["".join(draw.choice(letters) for _ in range(draw.randrange(1, 7))) for _ in range(300)]
    for i in range(240):
        text = " .;1".join(draw.choice(vocabulary[:40] if draw.random() < 0.7 else vocabulary) for _ in range(draw.randrange(0, 60)))
        rows.append((i, text, draw.choice(["en", "de", None]), f"s{draw.randrange(5)}"))
    rows += [(1, None, "en", None), (1, "", "en", "s1"), (None, "aB bé", "en", "s1"), (7, "x " * 40_000 + "aa" * 30_000, "en", "s2")]
    rows += [(500 + i, "aB bé ; 12", "en", "s1") for i in range(30)]  # copies
    rows += [(600, "only here", "xx", "s1"), (601, "only here", "yy", ""), (602, None, "yy", None), (603, "words", "yy", "s9")]
    return rows


@pytest.mark.parametrize(("shard_terms", "round_bytes", "tile", "block"), [(1 << 17, 64 << 20, 128, 1024), (7, 2000, 2, 5)])
def test_audit_equals_brute_force(spark, monkeypatch, shard_terms, round_bytes, tile, block):
    monkeypatch.setattr(divergence, "TILE", tile)
    monkeypatch.setattr(divergence, "BLOCK", block)
    rows = [(*r, 1, "clash", 2, "clash", 3) for r in corpus()]
    df = settings(spark).createDataFrame(rows, SCHEMA).repartition(5)
    found = divergence.audit(df, least_docs=8, top=20, shard_terms=shard_terms, round_bytes=round_bytes)
    got = [tuple(r) for r in found.select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(got) == len(set(got)) and set(got) == brute(corpus(), 8, 20)


def test_audit_of_no_documents(spark):
    assert divergence.audit(settings(spark).createDataFrame([], SCHEMA)).count() == 0


def test_transducer_gives_ordinals_and_terms():
    draw = random.Random(1)
    word = lambda letters: "".join(draw.choice(letters) for _ in range(draw.randrange(1, 9))).encode()
    terms = sorted({word("abcdé") for _ in range(3000)} | {b"a" * 3000})
    made = transducer.build(terms)
    assert list(made.terms()) == terms and len(made.final) < sum(map(len, terms)) / 3
    text = np.frombuffer(b", ".join([*terms, *(word("abcdéx") for _ in range(3000))]), np.uint8)
    starts, ends = transducer.words_in(text)
    place = {t: i for i, t in enumerate(terms)}
    assert made.ordinals(text, starts, ends).tolist() == [place.get(text[i:j].tobytes(), -1) for i, j in zip(starts, ends, strict=True)]
    assert list(transducer.build([]).terms()) == []


def test_equal_suffixes_share_states():
    made = transducer.build(sorted(a + b for a in (b"x", b"y", b"zz") for b in (b"ing", b"ings", b"ed")))
    assert len(made.final) == 8  # the start, after z, a stem, i, in, ing, e, and the end
