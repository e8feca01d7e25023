"""Operator 11: a toxicity classifier whose scores should not depend on which group a sentence mentions.

A logistic regression on the distinct words of letters of a whole text and on the first ``PREFIXES`` bytes of longer
ones (so that inflected forms count together). Language, source, ids and labels are no features.

1. Labels are read from rows that aren't held out: those whose crc32 of the doc_id as text leaves another remainder
   than ``held_out`` modulo 3. At most ``labelled`` of them, by the smallest hashes of their ids, form the sample.
2. Spark counts in how many toxic and other texts of the sample each feature occurs; features whose presence tells the
   classes apart clearly are chosen, at most ``FEATURES``. Only their places in the sample's texts reach the driver.
3. Every sentence of the sample that holds an identity term is written again with each other term of its class in the
   term's place, the class's neutral word included. The features that come and go are the sentence's counterfactual
   differences; equal ones are added up in Spark. The fit minimises the mean log loss plus ``pairing`` times the mean
   squared change of the log odds over these sentences, so that a term's own weight and its substitutes' agree, while
   words around it keep theirs.
4. Every fourth row of the sample is left out of the fit and calibrates its log odds (Platt).

Scoring reads each whole text once, in place; only the chosen features and weights are broadcast.

Of several labels of one id the worst counts, of several texts of one id the smallest is learnt from; labels with a
null id or null toxic are none. Null and empty texts have no features and get the calibrated intercept. A null doc_id
counts as an empty text in the crc32. Without five labels of both kinds every document gets the share of toxic labels
(0 without any). No documents, no rows; further columns of the input are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from folioscope.llm import words as w
from folioscope.llm.common import map_pieces, slices
from folioscope.llm.transducer import LOWER
from folioscope.session import cut_lineage

PREFIXES = (4, 5, 6)
#: Features of a model; least texts with a chosen one, and least distance from chance in standard deviations.
FEATURES, LEAST_TEXTS, CLEAR = 20_000, 5, 4.0
_FILTER = 1 << 16

#: Classes of identity terms, each with its neutral word first.
IDENTITIES: tuple[tuple[str, ...], ...] = (
    ("people", "women", "men", "girls", "boys", "lesbians", "gays", "transgender", "immigrants", "refugees", "natives"),
    ("people", "muslims", "christians", "jews", "hindus", "buddhists", "sikhs", "atheists", "catholics"),
    ("people", "africans", "asians", "americans", "europeans", "arabs", "mexicans", "indians", "blacks", "whites"),
    ("person", "woman", "man", "girl", "boy", "lesbian", "gay", "immigrant", "refugee", "muslim", "christian", "jew"),
    ("personal", "religious", "muslim", "christian", "jewish", "hindu", "buddhist", "catholic", "african", "asian"),
    ("menschen", "frauen", "männer", "muslime", "christen", "juden", "ausländer", "flüchtlinge", "schwule", "lesben"),
    ("personnes", "femmes", "hommes", "musulmans", "chrétiens", "juifs", "immigrés", "réfugiés", "africains"),
    ("personas", "mujeres", "hombres", "musulmanes", "cristianos", "judíos", "inmigrantes", "refugiados", "africanos"),
)


def remainder(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3


def features(text: bytes) -> np.ndarray:
    """Distinct features of a text, sorted."""
    parts = [np.unique(w.letter_words(part, PREFIXES)) for part in slices(text)]
    return np.unique(np.concatenate(parts)) if parts else np.empty(0, np.uint64)


def swapped(text: bytes, classes: Sequence[Sequence[str]]) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """Features gone and come, and the weight, of every swap of an identity term in a sentence of the text."""
    others: dict[bytes, set[bytes]] = {}
    for terms in classes:
        for term in terms:
            others.setdefault(term.encode(), set()).update(t.encode() for t in terms if t != term)
    term = re.compile(rb"(?<![A-Za-z\x80-\xff])(?:%s)(?![A-Za-z\x80-\xff])" % b"|".join(map(re.escape, sorted(others))))
    for part in slices(text.translate(LOWER.tobytes())):
        if not term.search(part):
            continue
        for sentence in re.split(rb"[.!?\n]+", part):
            own = None
            for met in term.finditer(sentence):
                own = features(sentence) if own is None else own
                swaps = sorted(others[met[0]])
                for other in swaps:
                    new = features(sentence[: met.start()] + other + sentence[met.end() :])
                    yield np.setdiff1d(own, new), np.setdiff1d(new, own), 1 / len(swaps)


@dataclass
class Model:
    #: Sorted features and their weights; calibrated log odds are ``slope * sum + bias``.
    chosen: np.ndarray
    weights: np.ndarray
    slope: float
    bias: float

    def __post_init__(self) -> None:
        self.seen = np.zeros(_FILTER, bool)
        self.seen[(self.chosen & np.uint64(_FILTER - 1)).astype(np.int64)] = True

    def score(self, text: bytes) -> float:
        found = []
        for part in slices(text):
            own = w.letter_words(part, PREFIXES)
            own = own[self.seen[(own & np.uint64(_FILTER - 1)).astype(np.int64)]]
            at = np.searchsorted(self.chosen, own)
            at[at == len(self.chosen)] = 0
            found.append(np.unique(at[self.chosen[at] == own]) if len(self.chosen) else at[:0])
        at = np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)
        return float(_sigmoid(self.slope * self.weights[at].sum() + self.bias))


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class _Rows:
    """Sparse rows of (columns, values)."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], width: int) -> None:
        self.n, self.width = len(rows), width
        self.columns = np.concatenate([r[0] for r in rows]) if rows else np.empty(0, np.int64)
        self.values = np.concatenate([r[1] for r in rows]) if rows else np.empty(0)
        self.owner = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])

    def times(self, x: np.ndarray) -> np.ndarray:
        return np.bincount(self.owner, weights=self.values * x[self.columns], minlength=self.n)

    def back(self, x: np.ndarray) -> np.ndarray:
        return np.bincount(self.columns, weights=self.values * x[self.owner], minlength=self.width)


def fit(rows: _Rows, y: np.ndarray, swaps: _Rows, shares: np.ndarray, pairing: float, ridge: float = 1e-4, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights and bias: log loss, counterfactual pairing and a small ridge, by Adam over all rows."""
    beta = np.zeros(rows.width + 1)
    beta[-1] = np.log(y.mean() / (1 - y.mean()))
    momentum, square = np.zeros_like(beta), np.zeros_like(beta)
    shares = shares / shares.sum() if len(shares) else shares
    for t in range(1, steps + 1):
        error = (_sigmoid(rows.times(beta[:-1]) + beta[-1]) - y) / rows.n
        gradient = np.r_[rows.back(error) + ridge * beta[:-1], error.sum()]
        if swaps.n:
            gradient[:-1] += 2 * pairing * swaps.back(shares * swaps.times(beta[:-1]))
        momentum, square = 0.9 * momentum + 0.1 * gradient, 0.99 * square + 0.01 * gradient**2
        beta -= 0.1 * (momentum / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.99**t)) + 1e-8)
    return beta[:-1], float(beta[-1])


def _calibrated(odds: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and bias of the log odds by Newton steps; targets a little inside 0 and 1 keep them finite."""
    target = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    x, beta = np.c_[odds, np.ones(len(odds))], np.array([1.0, 0.0])
    for _ in range(steps):
        p = _sigmoid(x @ beta)
        hessian = (x * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(hessian, x.T @ (target - p))
        beta += np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-8:
            break
    return float(max(beta[0], 0.0)), float(beta[1])


def _sample(docs: DataFrame, labels: DataFrame, labelled: int, held_out: int) -> DataFrame:
    """(doc_id, toxic, text) of at most ``labelled`` rows that aren't held out, one an id."""
    toxic = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    toxic = toxic.agg(F.max((F.col("toxic") == 1).cast("int")).alias("toxic")).where(remainder(F.col("doc_id")) != held_out)
    ids = docs.where("doc_id is not null").select("doc_id").distinct()
    drawn = toxic.join(ids, "doc_id").orderBy(F.xxhash64(F.lit(97), "doc_id"), "doc_id").limit(labelled)
    drawn = cut_lineage(drawn)  # bounded by ``labelled``, so its ids may be broadcast
    texts = docs.join(F.broadcast(drawn.select("doc_id")), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
    return cut_lineage(texts.join(F.broadcast(drawn), "doc_id"))


def _longs(rows: list[np.ndarray]) -> pa.Array:
    return pa.array([r.view(np.int64) for r in rows], pa.list_(pa.int64()))


def train(
    docs: DataFrame, labels: DataFrame, labelled: int = 16_000, held_out: int = 1, pairing: float = 20.0,
    classes: Sequence[Sequence[str]] = IDENTITIES,
) -> tuple[Model | None, float]:
    """The model, None where one kind of label is rarer than five, and the sample's share of toxic labels."""
    sample = _sample(docs, labels, labelled, held_out)

    def featured():
        def step(piece: pa.RecordBatch) -> pa.RecordBatch:
            found = [features(t or b"") for t in piece.column("text").to_pylist()]
            return pa.record_batch([piece.column("doc_id"), piece.column("toxic"), _longs(found)], ["doc_id", "toxic", "found"])

        return step

    def rewritten():
        def step(piece: pa.RecordBatch) -> pa.RecordBatch:
            met = [x for t in piece.column("text").to_pylist() for x in swapped(t or b"", classes)]
            return pa.record_batch([_longs([x[0] for x in met]), _longs([x[1] for x in met]), pa.array([x[2] for x in met], pa.float64())], ["gone", "come", "share"])

        return step

    rows = cut_lineage(map_pieces(sample.select("doc_id", "toxic", "text"), "text", featured, "doc_id long, toxic int, found array<long>"))
    n, toxic = rows.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if min(toxic, n - toxic) < 5:
        return None, toxic / n if n else 0.0
    met = rows.select("toxic", F.explode("found").alias("feature")).groupBy("feature").agg(F.count("*").alias("n"), F.sum("toxic").alias("t"))
    expected = F.col("n") * (toxic / n)
    far = (F.col("t") - expected) / F.sqrt(expected * (1 - toxic / n))
    clear = met.where((F.col("n") >= LEAST_TEXTS) & (F.abs(far) > CLEAR)).orderBy(F.desc(F.abs(far)), "feature").limit(FEATURES)
    clear = cut_lineage(clear.select("feature"))
    chosen = np.sort(np.array([r[0] for r in clear.collect()], np.int64).view(np.uint64))  # at most FEATURES
    kept = rows.select("doc_id", "toxic", F.explode_outer("found").alias("feature")).join(F.broadcast(clear.withColumn("own", F.col("feature"))), "feature", "left")
    held = kept.groupBy("doc_id", "toxic").agg(F.collect_list("own").alias("own")).collect()  # ``labelled`` rows of chosen features
    held.sort(key=lambda r: r["doc_id"])
    column = lambda found: np.searchsorted(chosen, np.sort(np.array(found, np.int64).view(np.uint64)))
    places = [column(r["own"]) for r in held]
    y = np.array([r["toxic"] for r in held], float)

    pairs = map_pieces(sample.select("text"), "text", rewritten, "gone array<long>, come array<long>, share double")
    pairs = pairs.groupBy("gone", "come").agg(F.sum("share").alias("share")).orderBy("gone", "come")
    known, swaps, shares = set(chosen.view(np.int64).tolist()), [], []
    for r in pairs.toLocalIterator():  # the sample's distinct swaps
        gone, come = ([x for x in r[k] if x in known] for k in ("gone", "come"))
        swaps.append((np.r_[column(gone), column(come)].astype(np.int64), np.r_[-np.ones(len(gone)), np.ones(len(come))]))
        shares.append(r["share"])

    taught = [i for i in range(len(held)) if i % 4]
    judges = [i for i in range(len(held)) if not i % 4]
    if min(y[taught].sum(), len(taught) - y[taught].sum()) < 1:
        return None, float(y.mean())
    sparse = lambda of: _Rows([(places[i], np.ones(len(places[i]))) for i in of], len(chosen))
    weights, bias = fit(sparse(taught), y[taught], _Rows(swaps, len(chosen)), np.array(shares), pairing)
    slope, shift = _calibrated(sparse(judges).times(weights) + bias, y[judges])
    return Model(chosen, weights, slope, slope * bias + shift), float(y.mean())


def score(docs: DataFrame, model: Model | None, share: float) -> DataFrame:
    """(doc_id, score) for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def task():
        model = shared.value

        def step(piece: pa.RecordBatch) -> pa.RecordBatch:
            scores = [share if model is None else model.score(t or b"") for t in piece.column("text").to_pylist()]
            return pa.record_batch([piece.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])

        return step

    return map_pieces(docs, "text", task, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, held_out: int = 1, **options) -> DataFrame:
    """doc_id, held_out, score and predicted for every document."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    scored = score(docs, *train(docs, labels, held_out=held_out, **options))
    return scored.select(
        "doc_id", (remainder(F.col("doc_id")) == held_out).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
