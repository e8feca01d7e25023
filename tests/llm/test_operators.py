"""Each operator against a brute-force version on small tables with nulls, ties, repeats, long and empty texts."""

import base64
import collections
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from folioscope.llm import arrow_ids, bpe, components, cotraining, flatgraph, lsh, mixing, ring, setjoin, substrings, words, wrappers
from folioscope.llm.common import settings

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tag string, key long, size string"


def prose(seed, n, vocabulary=400):
    draw = random.Random(seed)
    return [f"w{draw.randrange(vocabulary)}" for _ in range(n)]


def corpus():
    shared, rows = prose(1, 70), []
    base = prose(2, 120)
    for i in range(12):
        rows.append((i, " ".join(prose(100 + i, 60) + shared + prose(200 + i, 30)), "en", f"s{i % 3}"))
    for i in range(12, 30):  # near copies
        text = list(base)
        text[(i * 7) % 100] = f"x{i}"
        rows.append((i, " ".join(text), "en", "s0"))
    rows += [(i, " ".join(base), None, None) for i in range(30, 36)]  # copies
    rows += [(40, None, "en", "s1"), (41, "", "en", "s1"), (42, "one two", "en", "s2"), (43, "One  TWO", "en", "s2"), (44, " \t\n", "en", ""), (45, "a b " * 300, "en", "s1")]
    rows += [(46, "été naïve  x\n\ny 12中文 it's z " * 3, "fr", "s1"), (47, " ".join(prose(9, 6000)), "en", "s2"), (None, "no id here", "en", "s1")]
    rows += [rows[0], (3, "another text with the same id", "en", "s2"), (48, "z" * 5000, "de", "s1")]
    rows += [(49, "end <|endoftext|> inside\n<|endoftext|>", "en", "s1")]
    return [(i, t, lang, s, None if t is None else len(t), "clash", 7, "clash") for i, t, lang, s in rows]


@pytest.fixture(scope="module")
def docs(spark):
    settings(spark)
    return spark.createDataFrame(corpus(), SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return settings(spark).createDataFrame([], SCHEMA)


def ascii_words(text, fold=False):
    data = (text or "").encode()
    return (data.translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))) if fold else data).split()


# --- words and components -------------------------------------------------------------------------------------------


def test_word_hashes_follow_the_words():
    texts = [("a bb  a\tccc\n" * n).encode() for n in (0, 1, 5, 4000)] + [b"x" * 3_000_000 + b" y", ("w " * 700_000).encode()]
    for got, text in zip(words.batches(texts, False), texts, strict=True):
        plain = text.split()
        assert len(got) == len(plain)
        seen = {}
        assert all(seen.setdefault(w, h) == h for w, h in zip(plain, got.tolist(), strict=True))
        assert len(set(seen.values())) == len(seen)


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(5, i) for i in range(200, 260)] + [(7, 7), (None, 3), (300, 200)]
    got = {r["node"]: r["component"] for r in components.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 100 for i in range(100, 141)) and all(got[i] == 5 for i in range(200, 260)) and got[300] == 5
    assert 7 not in got and components.connected(spark.createDataFrame([], "a long, b long")).count() == 0


# --- 1 and 3: vectors -----------------------------------------------------------------------------------------------


def vectors():
    draw = np.random.default_rng(3)
    x = draw.standard_normal((700, 16))
    x[100:160] = x[100] + 0.05 * draw.standard_normal((60, 16))
    x[200:210] = x[200]
    x[210:215] = 2 * x[200]
    rows = [(i, v.astype(np.float32).tolist(), 1) for i, v in enumerate(x)]
    return rows + [(1000, None, 1), (1100, [0.0] * 16, 1), (1200, [float("nan")] * 16, 1), (1300, [1.0, None] * 8, 2), (1400, [float("inf")] + [0.0] * 15, 2), (1500, [1.0], 2), (None, [1.0] * 16, 1)]


def usable_vectors():
    rows = [r for r in vectors() if r[0] is not None and r[0] < 1000]
    return np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float32).astype(np.float64)


VECTORS = "vec_id long, embedding array<float>, label int"


def test_flat_graph_finds_links(spark):
    df = settings(spark).createDataFrame(vectors(), VECTORS)
    got = {r["vec_id"]: r for r in flatgraph.near_duplicates(df).collect()}
    ids, x = usable_vectors()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (u @ u.T) >= 0.9
    true, found = near.sum(1) - 1, np.array([got[i]["n_links"] for i in ids])
    assert len(got) == len(vectors()) and (found <= true).all() and found.sum() >= 0.95 * true.sum()
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i and got[i]["kept"] for i in (1000, 1100, 1200, 1300, 1400, 1500))
    assert {got[i]["component_id"] for i in range(200, 215)} == {200} and not got[210]["kept"]
    assert flatgraph.near_duplicates(spark.createDataFrame([], VECTORS)).count() == 0


def test_flat_graph_keeps_small_groups_beside_many_copies(spark, monkeypatch):
    monkeypatch.setattr(flatgraph, "SHARD", 4)  # so many shards that small groups fall apart
    x = np.random.default_rng(4).standard_normal((600, 4))
    x[400:] = x[400]
    x = x.astype(np.float32).astype(float)
    df = settings(spark).createDataFrame([(i, [float(v) for v in r], None) for i, r in enumerate(x)], VECTORS)
    got = {r["vec_id"]: r["n_links"] for r in flatgraph.near_duplicates(df).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    true = ((u @ u.T) >= 0.9).sum(1) - 1
    linked = np.flatnonzero(true[:400])
    assert np.mean([got[i] / true[i] for i in linked]) >= 0.97 and all(got[i] <= true[i] for i in range(600))


def test_every_link_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(flatgraph, "BLOCK", 100)
    ids, x = usable_vectors()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    df = settings(spark).createDataFrame([(int(i), 1, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, weight long, embedding array<float>")
    found = flatgraph._every_link(df, flatgraph.centroids(u, 5), 0.9)
    got = {r["vec_id"]: r["n"] for r in found.groupBy("vec_id").agg(F.sum("links").alias("n")).collect()}
    u = np.array(x, np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    assert [got.get(i, 0) for i in range(len(ids))] == (((u @ u.T) >= 0.9).sum(1) - 1).tolist()


def test_robust_pruning_and_search_recall():
    _, x = usable_vectors()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    q, n = flatgraph.search(u, u, flatgraph.build(u), 0.9)
    assert len(q) >= 0.97 * ((u @ u.T) >= 0.9).sum() and (np.einsum("ij,ij->i", u[q], u[n]) >= 0.9).all()


def test_multiprobe_recall_and_exact_scores(spark):
    df = settings(spark).createDataFrame(vectors(), VECTORS)
    rows = lsh.nearest(df, F.col("vec_id") % 100 == 0).collect()
    ids, x = usable_vectors()
    hit = 0
    for q in range(0, 700, 100):
        far = np.sqrt(((x - x[q]) ** 2).sum(1))
        far[q] = np.inf
        mine = sorted((r for r in rows if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 11))
        assert all(abs(r["score"] - far[r["vec_id"]]) < 1e-9 for r in mine)
        assert [(r["score"], r["vec_id"]) for r in mine] == sorted((r["score"], r["vec_id"]) for r in mine)
        hit += len({r["vec_id"] for r in mine} & set(np.lexsort((ids, far))[:10]))
    assert hit >= 0.9 * 70 and {r["query_id"] for r in rows} == set(range(0, 700, 100))
    few = lsh.nearest(spark.createDataFrame(vectors()[:4], VECTORS), F.col("vec_id") % 100 == 0).collect()
    assert [r["rank"] for r in few] == [1, 2, 3]
    assert lsh.nearest(spark.createDataFrame([], VECTORS), F.col("vec_id") % 100 == 0).count() == 0


def test_multiprobe_answers_outliers_in_full(spark):
    x = np.random.default_rng(6).standard_normal((3000, 4))
    x[40] = 1000.0
    rows = [(i, v.astype(np.float32).tolist(), 1) for i, v in enumerate(x)]
    got = [r for r in lsh.nearest(settings(spark).createDataFrame(rows, VECTORS), F.col("vec_id") % 20 == 0).collect() if r["query_id"] == 40]
    far = np.sqrt(((x.astype(np.float32).astype(float) - x[40]) ** 2).sum(1))
    far[40] = np.inf
    assert [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"])] == np.lexsort((np.arange(3000), far))[:10].tolist()


def test_probes_come_by_estimated_success():
    place = np.array([0.1, 0.6, 0.45])
    score = np.r_[place, 1 - place] ** 2
    got = [sum(score[i] for i in p) for p in lsh.probes(place, 27)]
    assert got == sorted(got) and len(got) == 27


# --- 2: mixing ------------------------------------------------------------------------------------------------------


def test_sainte_lague_takes_the_highest_quotients():
    draw = np.random.default_rng(1)
    for _ in range(30):
        votes, seats = draw.integers(0, 50, draw.integers(1, 8)).astype(float), int(draw.integers(0, 60))
        won = np.zeros(len(votes), int)
        for _ in range(seats if votes.sum() else 0):
            won[np.argmax(votes / (2 * won + 1))] += 1
        assert mixing.sainte_lague(votes, seats).tolist() == won.tolist()


def test_mixture_meets_targets(spark, docs, empty):
    rows = mixing.apportion(docs, block=4, shard_words=900).collect()
    again = mixing.apportion(docs.repartition(3), block=4, shard_words=900).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again)) and len(rows) == docs.count()
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    sizes, taken, target = collections.Counter(), collections.Counter(), {}
    for r in rows:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    total, open_, want = 1.5 * sum(sizes.values()), set(order), {}
    while True:
        level = (total - sum(want.values())) / sum(weight[s] for s in open_) if open_ else 0
        full = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        if not full:
            break
        want.update({s: 2.0 * sizes[s] for s in full})
        open_ -= full
    want.update({s: level * weight[s] for s in open_})
    assert all(abs(want[s] - target[s]) < 1e-6 for s in order)
    assert all(abs(taken[s] - target[s]) <= 0.02 * target[s] + 8 for s in order)
    assert mixing.apportion(empty).count() == 0 and mixing.mix_documents(empty).count() == 0


def test_mixed_texts_hold_the_words_taken(docs):
    plain = docs.dropDuplicates(["doc_id", "text"])
    want = {(r["doc_id"], r["text_key"]): r["taken"] for r in mixing.apportion(plain, block=4).collect()}
    mixed = mixing.mix_documents(docs, block=4)
    assert mixed.columns == docs.columns
    assert sum(len(ascii_words(r["text"])) for r in mixed.collect()) == sum(want.values())


# --- 4: pages -------------------------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var a="</p>";</script></head><body><header>Site</header>
<nav><ul><li><a href=/>Home</a></li></ul></nav><!-- c --><div class="cookie-notice">We use cookies</div><div class=ad>Buy</div>
<article><h1>Title &amp; %(n)s</h1><p>Read more at our place.</p><p><b>First  %(n)s para<br>graph &lt;x&gt;.<p>Second %(words)s</p><ul><li>one %(n)s<li>two &copy; %(n)s</ul>
<div class="comments"><p>nice</p></div></article><aside>side</aside><form>f</form><footer>foot</footer>%(end)s"""


def page(n, end="</body></html>"):
    return PAGE % {"n": n, "words": " ".join(prose(n, 40)), "end": end}


def test_pages(spark):
    rows = [(i, f"http://h.example/{i}", page(i)) for i in range(12)] + [(20, "http://other.example/", page(20, "")), (21, None, None), (22, "x", ""), (23, "x", "plain text < 5 & more")]
    df = settings(spark).createDataFrame([(*r, "clash", "clash") for r in rows], "page_id long, url string, html string, text string, host string")
    got = {r["page_id"]: r for r in wrappers.extract(df).collect()}

    def want(n, template):
        read = [] if template else ["Read more at our place."]
        return "\n\n".join([f"Title & {n}", *read, f"First {n} para graph <x>.", "Second " + " ".join(prose(n, 40)), f"one {n}", f"two © {n}"])

    assert all(got[i]["text"] == want(i, True) for i in range(12))  # the sentence all pages share is template
    assert got[20]["text"] == want(20, False)  # one page is no sample
    assert got[21]["text"] == "" and got[22]["text"] == "" and got[23]["text"] == "plain text < 5 & more"
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())
    copies = [(i, f"http://c.example/{i}", page(3)) for i in range(12)]
    kept = wrappers.extract(spark.createDataFrame(copies, "page_id long, url string, html string")).collect()
    assert all(r["text"] == want(3, False) for r in kept)  # copies of one page are no template
    assert wrappers.extract(df.limit(0)).count() == 0


def test_short_pages_with_much_boilerplate_get_a_template(spark):
    notice = "<div>" + " ".join(prose(77, 35)) + "</div>"
    rows = [(i, f"http://n.example/{i}", f"<html><body>{notice}<p>only page {i} says w{i}</p></body></html>") for i in range(4)]
    got = wrappers.extract(settings(spark).createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r["page_id"]: r["text"] for r in got} == {i: f"only page {i} says w{i}" for i in range(4)}


def test_linked_titles_teasers_and_slug_ids_keep_their_text():
    body = "<h1><a href=/t>A linked title</a></h1><p>Some words of the page itself.</p><p><a href=/p>A linked paragraph</a></p><ul><li><a href=/r>First reference</a></ul>"
    kept = "A linked title\n\nSome words of the page itself.\n\nA linked paragraph\n\nFirst reference"
    assert wrappers.main_text(f"<body><ul><li><a href=/s>Start</a></ul><div>{body}</div></body>") == kept
    teaser = wrappers.main_text(f"<body><div>{body}</div><article>Teaser</article></body>")
    assert teaser == kept + "\n\nTeaser"
    ids = "<article><h2 id='social-security'>Security</h2><section id='related-work'><p>Work</p></section><div class='related'>Other</div><div id='comments'>Nice</div></article>"
    assert wrappers.main_text(ids) == "Security\n\nWork"


# --- 5: sharding ----------------------------------------------------------------------------------------------------


def test_ring_shards(spark, docs, empty):
    rows = ring.shard_documents(docs).collect()
    want = collections.Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in corpus())
    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    for s in range(8):
        mine = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert mine == list(range(len(mine)))
    assert ring.shard_documents(empty).count() == 0
    many = spark.range(20000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("hot copy")).otherwise(F.concat(F.lit("text "), (F.col("id") / 2).cast("long"))).alias("text"))
    placed = ring.shard_documents(many).cache()
    loads = [r[0] for r in placed.groupBy("shard").agg(F.sum("size")).select("sum(size)").collect()]
    assert len(loads) == 8 and max(loads) <= 1.01 * sum(loads) / 8
    cold = placed.join(many, "doc_id").where("text <> 'hot copy'").groupBy("text").agg(F.countDistinct("shard").alias("n"))
    assert cold.where("n > 1").count() == 0


# --- 6: quality -----------------------------------------------------------------------------------------------------


def test_co_training_on_held_out_labels(spark, empty):
    rows, labels = [], []
    for i in range(900):
        kind = i % 3  # good, shouting, insulting
        text = prose(i, 80)
        text = [w.upper() + "!!" for w in text] if kind == 1 else text
        for j in (5, 20, 50) if kind == 2 else ():
            text[j] = f"insult{'abcdef'[(i + j) % 6]}"
        rows.append((i, " ".join(text), "en", f"s{i % 4}", None))
        if i < 500:
            labels.append((i, 0 if kind == 1 else 1, int(kind == 2)))
    rows += [(2000, None, None, None, None), (2001, "", None, "s", 0)]
    labels += [(None, 1, 0), (3, None, 1), (4, 1, None)]
    df = settings(spark).createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in cotraining.classify(df, known).collect()}
    unseen = [got[i]["accepted"] == (i % 3 == 0) for i in range(500, 900)]
    assert len(got) == len(rows) and np.mean(unseen) >= 0.95
    assert all(r["accepted"] for r in cotraining.classify(df, known.limit(0)).collect())
    assert cotraining.classify(empty, known).count() == 0


# --- 7: Jaccard join ------------------------------------------------------------------------------------------------


def brute_components(rows, k, percent):
    sets = []
    for i, text, *_ in rows:
        w = ascii_words(text, True)
        sets.append((i, frozenset(tuple(w[p : p + k]) for p in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])))
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            (i, s), (j, t) = sets[a], sets[b]
            if s and t and i is not None and j is not None and 100 * len(s & t) >= percent * len(s | t):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {(i, len(s), find(i) if i is not None else None) for i, s in sets}


@pytest.mark.parametrize(("k", "percent"), [(4, 85), (5, 80)])
def test_jaccard_components(docs, k, percent):
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in setjoin.join_sets(docs, k, percent).collect()}
    assert got == brute_components(corpus(), k, percent)


def test_one_of_each_group_stays(docs, empty):
    kept = [r["doc_id"] for r in setjoin.one_of_each(docs).collect()]
    want = {i for i, _, c in brute_components(corpus(), 5, 80) if i == c}
    assert sorted(x for x in kept if x is not None) == sorted(x for x in want if x is not None) and None in kept
    assert setjoin.join_sets(empty).count() == 0


def near_prose(n, words, seed):
    """Copies of a few texts with edits around the threshold, and texts that share a passage and nothing else."""
    rng, rows = np.random.default_rng(seed), []
    passages = [[f"p{p}x{i}" for i in range(40)] for p in range(3)]
    for i in range(n):
        if i % 2:
            base = [f"b{i % 6}x{j}" for j in range(words - i % 9)]
            for at in rng.integers(0, len(base), i % 7):
                base[at] = f"e{i}x{at}"
        else:
            base = [f"u{i}x{j}" for j in range(words)] + passages[i % 3]
        rows.append((i, " ".join(base)))
    return rows


def test_jaccard_components_whatever_the_order_of_shingles(spark, monkeypatch):
    monkeypatch.setattr(setjoin, "_sketch", lambda *_: np.zeros(setjoin.COUNTERS, np.uint8))  # as a full sketch
    settings(spark)
    for words, percent in ((14, 80), (150, 85)):
        rows = near_prose(120, words, words)
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in setjoin.join_sets(docs, 4, percent).collect()}
        assert got == brute_components(rows, 4, percent)


def test_texts_that_share_passages_are_no_candidates(spark, monkeypatch):
    opened, open_groups = [], setjoin._open_groups

    def count(candidates, members, *rest):
        opened.append((candidates.count(), members.count()))
        return open_groups(candidates, members, *rest)

    monkeypatch.setattr(setjoin, "_sketch", lambda *_: np.zeros(setjoin.COUNTERS, np.uint8))
    monkeypatch.setattr(setjoin, "_open_groups", count)
    rows = [row for row in near_prose(120, 300, 1) if row[0] % 2 == 0]
    docs = settings(spark).createDataFrame(rows, "doc_id long, text string")
    assert setjoin.join_sets(docs, 5, 80).where("doc_id <> component_id").count() == 0
    assert opened == [(0, 0)]


# --- 8: substrings --------------------------------------------------------------------------------------------------


def brute_repeats(rows, window):
    first = {}
    for i, text, *_ in rows:
        w = ascii_words(text)
        for p in range(len(w) - window + 1):
            key = tuple(w[p : p + window])
            if i is not None:
                first[key] = min(i, first.get(key, i))
    out = []
    for i, text, *_ in rows:
        w = ascii_words(text)
        gone = set()
        for p in range(len(w) - window + 1):
            if i is not None and first[tuple(w[p : p + window])] < i:
                gone.update(range(p, p + window))
        kept = b" ".join(x for p, x in enumerate(w) if p not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return collections.Counter(out)


def test_repeated_spans(docs, empty):
    rows = substrings.remove_repeats(docs).collect()
    assert collections.Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in rows) == brute_repeats(corpus(), 50)
    assert substrings.remove_repeats(empty).count() == 0
    cut = substrings.without_repeats(docs)
    assert cut.columns == docs.columns and cut.count() == docs.count()


def test_branching_repeats(spark):
    draw = random.Random(8)
    parts = [prose(i, 60, 30) for i in range(6)]
    rows = []
    for i in range(40):
        text = [w for _ in range(draw.randrange(1, 5)) for w in draw.choice(parts)[draw.randrange(20) :]] + ["x", "y"] * draw.randrange(60)
        rows.append((i, " ".join(text)))
    got = substrings.remove_repeats(settings(spark).createDataFrame(rows, "doc_id long, text string")).collect()
    assert collections.Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == brute_repeats(rows, 50)


# --- 9 and 10: tokens -----------------------------------------------------------------------------------------------


def test_arrow_files(docs, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    manifest = arrow_ids.write_files(docs, path, public_tokenizers.PATTERN, length=64)
    got = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in arrow_ids.read_documents(manifest).collect())
    want, at, stream = [], 0, []
    for i, text, *_ in sorted(corpus(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((at, i, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
        stream.append(ids)
    assert got == want
    assert any(library.token_to_id("<|endoftext|>") in x for x in stream)
    first = manifest.orderBy("base").first()
    ids, mask = arrow_ids.read_sequence(first["path"], 1)
    assert mask[:10].all() and ids[:10].tolist() == np.concatenate(stream)[64:74].tolist()
    assert arrow_ids.read_documents(arrow_ids.write_files(empty, path, public_tokenizers.PATTERN)).count() == 0


def test_byte_level_bpe(docs, empty):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = collections.Counter()
    for i, text, *_ in corpus():
        ids = own.encode_ordinary(text or "")
        want[i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()] += 1
    rows = bpe.digest(bpe.decode(bpe.encode(docs, path, public_tokenizers.PATTERN), path)).collect()
    assert collections.Counter(tuple(r) for r in rows) == want
    rows = bpe.digest(bpe.round_trip(docs, path, public_tokenizers.PATTERN)).collect()
    assert collections.Counter(tuple(r) for r in rows) == want
    assert bpe.encode(empty, path, public_tokenizers.PATTERN).count() == 0


def test_perfect_hash_is_minimal_and_complete():
    entries = {f"k{i}".encode(): i for i in range(3000)}
    found = bpe.PerfectHash(entries)
    assert len(found.keys) == len(entries) and all(found[k] == v for k, v in entries.items()) and found[b"other"] == -1


# --- pipeline -------------------------------------------------------------------------------------------------------


def test_pipeline_stages_follow_each_other(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    counts = []
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        columns = docs.columns
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{n}")
        docs = spark.read.parquet(f"{tmp_path}/{n}")
        counts.append(docs.count())
        assert n == 4 or docs.columns == columns
    assert counts[0] <= 200 and counts[1] < counts[0] and counts[2] == counts[1] and counts[4] == counts[3]
