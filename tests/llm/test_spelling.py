"""Operator 13 against brute force."""

import collections
import random
import re
import zlib

import numpy as np
import pytest

from folioscope.llm import spelling
from folioscope.llm.common import settings

SCHEMA = "doc_id long, text string, lang string, word string, n string, key long, size int"


def brute(rows):
    n = collections.Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}
    near = collections.defaultdict(set)
    for w in n:
        for i in range(len(w) + 1):
            edits = [w[:i] + x + w[i + j :] for x in spelling.LETTERS for j in (0, 1) if i + j <= len(w)] + [w[:i] + w[i + 1 :]]
            near[w] |= {e for e in edits if e in n and e != w}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    root = lambda w: root(form[w]) if form[w] else w
    return {(w, form[w], root(w), n[w], len(near[w]), n.get(form[w])) for w in n}


def corpus():
    draw, rows = random.Random(11), []
    stems = ["".join(draw.choice("abcdeéÿ×") for _ in range(draw.randrange(6, 12))) for _ in range(40)]
    weights = [1 / (i + 1) ** 2 for i in range(len(stems))]

    def word():
        w = list(draw.choices(stems, weights)[0])
        if draw.random() < 0.2:
            at = draw.randrange(len(w))
            w[at : at + draw.randrange(2)] = draw.choice(["", "a", "é", "bb", "Z"])
        return "".join(w).upper() if draw.random() < 0.02 else "".join(w)

    for i in range(150):
        rows.append((i, draw.choice([" ", "-", "1", "…"]).join(word() for _ in range(draw.randrange(0, 120)))))
    rows += [(5, None), (6, ""), (None, "aaaaaaab " * 30), (7, "abcdefg ABCDEFG Ábcdefg ábcdefg" * 3), rows[3], rows[3]]
    # chains of forms, each ten times as frequent as the one before; equal letters in a row; ties; one word of a great length
    rows += [(900 + i, "chainaaa " * 3) for i in range(1)] + [(910, "chainaab " * 40), (911, "chainabb " * 500), (912, "chainbbb " * 6000)]
    rows += [(920, "tietiea tietieb tietiec " * 2), (921, "q" * 70_000 + " x " + "q" * 70_001), (922, "q" * 70_001 + " " + "q" * 70_000)]
    return rows


@pytest.mark.parametrize("options", [{}, {"round_bytes": 64, "shard_words": 20}])
def test_variants_equal_brute_force(spark, options):
    short = [r for r in corpus() if r[0] not in (921, 922)]
    df = settings(spark).createDataFrame([(*r, "en", "clash", "clash", 1, 2) for r in short], SCHEMA).repartition(4)
    got = [tuple(r) for r in spelling.variants(df, **options).select("word", "form", "root", "n", "n_near", "form_n").collect()]
    expected = brute(short)
    assert len(got) == len(set(got)) and set(got) == expected
    assert any(r[1] and r[1] != r[2] for r in expected) and any(r[4] > 5 for r in expected)


def test_words_of_great_length(spark):
    df = settings(spark).createDataFrame([r for r in corpus() if r[0] in (921, 922)], "doc_id long, text string")
    got = {len(r["word"]): (r["n"], r["n_near"], r["form"]) for r in spelling.variants(df).collect()}
    assert got == {70_000: (2, 1, None), 70_001: (2, 1, None)}


def test_no_documents(spark):
    assert spelling.variants(settings(spark).createDataFrame([], SCHEMA)).count() == 0


def test_filters_let_all_keys_and_few_others_through():
    keys = np.random.default_rng(1).integers(0, 1 << 63, 200_000).astype(np.uint64)
    own, other = keys[:100_000], keys[100_000:]
    bits = np.zeros(len(own) * spelling.BITS_A_WORD // 64, np.uint64)
    at, mask = spelling._blocks(own, len(bits))
    np.bitwise_or.at(bits, at, mask)
    probe = spelling._Probe([(9, 1, [0])], [(9, 0, bits.tobytes())])
    assert len(probe.passed(own, 9)) == len(own) and len(probe.passed(other, 9)) < 0.03 * len(other)
