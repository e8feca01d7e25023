"""Operator 6: a quality classifier by co-training of a text view and a page-metadata view.

The text view sees which words a document holds; the metadata view sees source, language, sizes and the layout's
statistics (shares of capitals, signs, repeated lines, ...), never a word. Each is a logistic regression. In every
round each view labels the documents of an unlabelled pool that it is most sure of, and the other view learns from
them, too. Labelled rows held back from training calibrate both views (Platt) and weigh them into one probability.

Training needs bounded samples only: ``labelled`` and ``pool`` rows with the smallest hashes of their ids, so it costs
the same at any size of the corpus. Their features, not their texts, come to the driver. Scoring reads every document
once, in place: nothing is shuffled, and the model (a vector of ``BUCKETS`` weights) is broadcast.

A document is good if its label says quality 1 and not toxic; of several labels of one id the worst counts; rows with
a null quality or id are no labels. Null and empty texts have no words; null source and language are values of their
own. Without labels of both kinds every document gets the share of good labels (1 without any) and is accepted.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from folioscope.llm import words as w
from folioscope.llm.common import map_pieces, pieces

#: Hash buckets of words, and of source and language in the metadata view.
BUCKETS, NAMES = 1 << 18, 32
#: Bytes of word beginnings that are features of their own, so that inflected words count together.
PREFIXES = (4, 5, 6)
_LIMIT = 30.0

_CLASS = np.zeros(256, np.int64)  # other, capitals, small letters, digits, space, ! ?, bars, other signs, beyond ASCII
for _bytes, _kind in ((range(65, 91), 1), (range(97, 123), 2), (range(48, 58), 3), (b" \t\n\r\x0b\x0c", 4), (b"!?", 5), (b"|<>{}[]\\", 6), (b"#$%&*+=@^_~`", 7), (range(128, 256), 8)):
    _CLASS[list(_bytes)] = _kind


def text_view(text: bytes) -> np.ndarray:
    """Distinct buckets of the words of letters and of their beginnings."""
    return np.unique(w.letter_words(text, PREFIXES) & np.uint64(BUCKETS - 1)).astype(np.int64)


def meta_view(text: bytes, distinct: int, source: str | None, lang: str | None) -> np.ndarray:
    """Statistics of the page and its names; nothing that depends on which words it has."""
    out = np.zeros(20 + NAMES)
    counts, size = np.zeros(9), max(1, len(text))
    for at in range(0, len(text), w.PIECE_BYTES):
        counts += np.bincount(_CLASS[np.frombuffer(text, np.uint8, min(w.PIECE_BYTES, len(text) - at), at)], minlength=9)
    out[:9] = np.minimum(counts / size * 10, 5)
    lines = [x for x in text.split(b"\n") if x.strip()]
    letters, n_words = counts[1] + counts[2] + counts[8], max(1, text.count(b" ") + len(lines))
    out[9] = counts[1] / max(1.0, letters)
    out[10], out[11], out[12] = np.log1p(len(text)) / 3, np.log1p(len(lines)) / 2, np.log1p(size / max(1, len(lines))) / 3
    out[13] = 1 - len(set(lines)) / max(1, len(lines))
    out[14] = min(size / n_words, 40) / 10
    out[15] = distinct / n_words
    out[16] = float(counts[1] > counts[2])
    out[17], out[18] = np.sqrt(counts[5] / size), np.sqrt(counts[6] / size)
    out[19] = np.sqrt(counts[7] / size)
    for name in (f"source/{source}", f"lang/{lang}"):
        out[20 + int(w.word_hashes(name.encode(), True)[0] % np.uint64(NAMES))] += 1
    return out


@dataclass
class Model:
    text_weights: np.ndarray
    text_bias: float
    meta_weights: np.ndarray
    meta_bias: float
    meta_mean: np.ndarray
    meta_scale: np.ndarray
    #: Intercept and weights of the two views' log odds.
    blend: np.ndarray
    text_platt: np.ndarray
    meta_platt: np.ndarray
    threshold: float

    def logits(self, text: np.ndarray, meta: np.ndarray) -> tuple[float, float]:
        x = self.text_bias + self.text_weights[text].sum()
        y = self.meta_bias + ((meta - self.meta_mean) / self.meta_scale) @ self.meta_weights
        return float(np.clip(x, -_LIMIT, _LIMIT)), float(np.clip(y, -_LIMIT, _LIMIT))

    def scores(self, text: np.ndarray, meta: np.ndarray) -> tuple[float, float, float]:
        x, y = self.logits(text, meta)
        return _sigmoid(self.text_platt @ (1, x)), _sigmoid(self.meta_platt @ (1, y)), _sigmoid(self.blend @ (1, x, y))


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -_LIMIT, _LIMIT)))


def _fit_dense(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3, steps: int = 30) -> np.ndarray:
    """Logistic regression by Newton steps; the first column is the intercept."""
    x = np.c_[np.ones(len(x)), x]
    beta, total = np.zeros(x.shape[1]), weight.sum()
    penalty = np.full(x.shape[1], ridge * total)
    penalty[0] = 1e-6 * total
    for _ in range(steps):
        p = _sigmoid(x @ beta)
        hessian = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(hessian, x.T @ (weight * (y - p)) - penalty * beta)
        beta += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-6:
            break
    return beta


def _fit_text(rows: list[np.ndarray], y: np.ndarray, weight: np.ndarray, steps: int = 150) -> tuple[np.ndarray, float]:
    """Logistic regression on the words whose presence tells the classes apart clearly; the others weigh nothing."""
    total, good = weight.sum(), (weight * y).sum()
    df, in_good = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for row, w_, y_ in zip(rows, weight, y, strict=True):  # a row's buckets are distinct
        df[row] += w_
        in_good[row] += w_ * y_
    expected = df * good / total
    z = (in_good - expected) / np.sqrt(np.maximum(expected * (1 - good / total), 1e-9))
    chosen = np.flatnonzero((df >= 5) & (np.abs(z) > 4))
    weights, bias = np.zeros(BUCKETS), float(np.log(good / (total - good)))
    if not len(chosen):
        return weights, bias
    column = np.full(BUCKETS, -1, np.int32)
    column[chosen] = np.arange(len(chosen))
    kept = [c[c >= 0] for c in (column[row] for row in rows)]
    cols, owner = np.concatenate(kept), np.repeat(np.arange(len(rows), dtype=np.int32), [len(c) for c in kept])
    beta, momentum, square = np.zeros(len(chosen) + 1), np.zeros(len(chosen) + 1), np.zeros(len(chosen) + 1)
    beta[-1] = bias
    for t in range(1, steps + 1):  # Adam
        p = _sigmoid(np.bincount(owner, weights=beta[cols], minlength=len(rows)) + beta[-1])
        error = weight * (p - y) / total
        gradient = np.r_[np.bincount(cols, weights=error[owner], minlength=len(chosen)) + 1e-5 * beta[:-1], error.sum()]
        momentum, square = 0.9 * momentum + 0.1 * gradient, 0.99 * square + 0.01 * gradient**2
        beta -= 0.15 * (momentum / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.99**t)) + 1e-8)
    weights[chosen] = beta[:-1]
    return weights, float(beta[-1])


def co_train(
    labelled: list[tuple[np.ndarray, np.ndarray, int]], pool: list[tuple[np.ndarray, np.ndarray]],
    rounds: int = 3, each: float = 0.05, sure: float = 0.98, pseudo_weight: float = 0.25, threshold: float = 0.5,
) -> Model | None:
    """Model from (text, metadata, good) rows and unlabelled rows; None unless both labels occur often enough.

    A round moves at most the part ``each`` of the pool from one view to the other, only where the giving view's
    probability is beyond ``sure``. Every fourth labelled row is held back for calibration.
    """
    held, taught = labelled[::4], [r for i, r in enumerate(labelled) if i % 4]
    y = np.array([r[2] for r in taught], float)
    if min(y.sum(), len(y) - y.sum()) < 5 or len({r[2] for r in held}) < 2:
        return None
    meta = np.array([r[1] for r in taught])
    mean, scale = meta.mean(0), np.maximum(meta.std(0), 1e-3)
    pool_meta = (np.array([r[1] for r in pool]) - mean) / scale if pool else np.empty((0, len(mean)))
    extra: dict[str, dict[int, float]] = {"text": {}, "meta": {}}  # pool row to pseudo-label, by the view that learns it

    def fit() -> Model:
        sides = {}
        for view in ("text", "meta"):
            more = sorted(extra[view].items())
            target = np.r_[y, [v for _, v in more]]
            weight = np.r_[np.ones(len(y)), np.full(len(more), pseudo_weight)]
            if view == "text":
                sides[view] = _fit_text([r[0] for r in taught] + [pool[i][0] for i, _ in more], target, weight)
            else:
                beta = _fit_dense(np.r_[(meta - mean) / scale, pool_meta[[i for i, _ in more]]] if more else (meta - mean) / scale, target, weight)
                sides[view] = beta[1:], float(beta[0])
        return Model(*sides["text"], *sides["meta"], mean, scale, np.zeros(3), np.zeros(2), np.zeros(2), threshold)

    model = fit()
    for _ in range(rounds if pool else 0):
        odds = np.array([model.logits(*r) for r in pool])
        for giver, taker in ((0, "meta"), (1, "text")):
            p = _sigmoid(odds[:, giver])
            order = np.argsort(-np.abs(p - 0.5), kind="stable")
            new = [int(i) for i in order if int(i) not in extra[taker] and max(p[i], 1 - p[i]) >= sure]
            extra[taker].update({i: float(p[i] > 0.5) for i in new[: max(1, int(each * len(pool)))]})
        model = fit()
    odds, truth = np.array([model.logits(r[0], r[1]) for r in held]), np.array([r[2] for r in held], float)
    ones = np.ones(len(held))
    model.text_platt, model.meta_platt = (_fit_dense(odds[:, [v]], truth, ones) for v in (0, 1))
    model.blend = _fit_dense(odds, truth, ones)
    return model


_FEATURES = "doc_id long, words binary, meta binary"


def _features(docs: DataFrame) -> DataFrame:
    def task():
        def step(piece: pa.RecordBatch) -> pa.RecordBatch:
            words, meta = [], []
            for text, source, lang in zip(*(piece.column(c).to_pylist() for c in ("text", "source", "lang")), strict=True):
                found = text_view(text or b"")
                words.append(found.astype("<i4").tobytes())
                meta.append(meta_view(text or b"", len(found), source, lang).tobytes())
            return pa.record_batch([piece.column("doc_id"), pa.array(words, pa.binary()), pa.array(meta, pa.binary())], ["doc_id", "words", "meta"])

        return step

    return map_pieces(docs, "text", task, _FEATURES)


def _columns(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), "source", "lang")


def train(docs: DataFrame, labels: DataFrame, labelled: int = 8000, pool: int = 2000, **options) -> tuple[Model | None, float]:
    """The model and the share of good labels in its sample."""
    docs = _columns(docs)
    order = F.xxhash64(F.lit(41), "doc_id"), F.col("doc_id")
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    known = known.agg(F.min(((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).cast("int")).alias("good"))
    spark = docs.sparkSession
    chosen = known.orderBy(*order).limit(labelled).collect()  # bounded by ``labelled``
    drawn = docs.where("doc_id is not null").select("doc_id").orderBy(*order).limit(4 * pool)
    free = [r[0] for r in drawn.join(known, "doc_id", "left_anti").orderBy(*order).limit(pool).collect()]  # by ``pool``
    good = {r["doc_id"]: r["good"] for r in chosen}
    wanted = spark.createDataFrame([(i,) for i in sorted({*good, *free})], "doc_id long")
    # The sample's ids are bounded, so the texts stay where they are.
    rows = _features(docs.join(F.broadcast(wanted), "doc_id", "left_semi")).toLocalIterator()
    held = {r["doc_id"]: (np.frombuffer(r["words"], "<i4"), np.frombuffer(r["meta"])) for r in rows}
    taught = [(*held[i], g) for i, g in good.items() if i in held]
    share = float(np.mean([r[2] for r in taught])) if taught else 1.0
    return co_train(taught, [held[i] for i in free if i in held], **options), share


def score(docs: DataFrame, model: Model | None, share: float) -> DataFrame:
    """``docs`` and p_text, p_meta, score and accepted, for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for piece in pieces(iter([batch]), "text"):
                out = []
                for text, source, lang in zip(*(piece.column(c).to_pylist() for c in ("text", "source", "lang")), strict=True):
                    if model is None:
                        out.append((share, share, share, True))
                        continue
                    raw = (text or "").encode()
                    words = text_view(raw)
                    p = model.scores(words, meta_view(raw, len(words), source, lang))
                    out.append((*map(float, p), bool(p[2] >= model.threshold)))
                columns = [pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.float64(),) * 3 + (pa.bool_(),), strict=True)]
                yield pa.RecordBatch.from_arrays([*piece.columns, *columns], [*piece.schema.names, "p_text", "p_meta", "score", "accepted"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{fields}, p_text double, p_meta double, score double, accepted boolean")


def classify(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The columns doc_id, text, lang, source, n_chars of ``docs`` with the scores of every document."""
    columns = docs.select("doc_id", "text", "lang", "source", "n_chars")
    return score(columns, *train(columns, labels, **options))
