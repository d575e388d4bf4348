"""Toxic spans and document scores from a linear-chain conditional random field.

Training reads a bounded sample of labelled documents (``TRAIN_TOXIC`` and
``TRAIN_CLEAN`` rows of at most ``TRAIN_CHARS`` characters, the lowest by a hash
of doc_id). Labels are per document, so token labels are found first: a token of
a toxic document is labelled toxic if its word, or a beginning or end of it,
stands in far more toxic than clean documents, by a confidence bound on the log
ratio. A two-state chain is then fitted to the labelled tokens by gradient steps
on the conditional likelihood, with forward-backward marginals as expectations.

Scoring tags every token of the whole text: forward-backward gives each token's
marginal; tokens of 0.5 or more are the offending spans, and a document's largest
marginal and expected number of toxic tokens go through a logistic map, fitted on
sampled documents that the tagging chain has not seen, to a score. The text is the only
input of a score.

Defined results: null and empty texts have no spans and the score of a document
without a toxic token; null ids are scored, too, and never learnt from; repeated
rows stay; with fewer than ``2 * FOLDS`` labelled documents of either kind every score is 0.
"""

from __future__ import annotations

import math
import pickle
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Memory, forgetting, small_batches

TRAIN_TOXIC, TRAIN_CLEAN, TRAIN_CHARS = 1_500, 3_500, 20_000
#: Clean documents of the sample whose tokens the chain is fitted to, those of least hash.
CHAIN_CLEAN = 750
#: Hashed weights; gradient steps.
WEIGHTS, STEPS = 1 << 18, 50
#: Least lower bound of the log ratio for a token label.
CLEAR = math.log(16.0)
#: Cross-fitting of the logistic map.
FOLDS = 3
THRESHOLD = 0.7
#: Entries of a generation of a worker's memory of words.
MEMO = 100_000
#: Words whose features are made at once; each word's are its own.
BLOCK = 20_000

_TOKEN = re.compile(r"\w+")


def word_features(words: list[str]) -> np.ndarray:
    """Hashed features, a row per word: the word, its length, its beginnings of 2-8 and
    its ends of 2-6 characters (shorter than the word). Absent ones are ``WEIGHTS``."""
    if len(words) > BLOCK:
        return np.concatenate([word_features(words[at:at + BLOCK]) for at in range(0, len(words), BLOCK)])
    low = [w.lower() for w in words]
    code = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    size = np.array([len(w) for w in low], dtype=np.int64)
    start = np.cumsum(size) - size
    prime, out = np.uint64(0x9E3779B97F4A7C15), []

    def put(kind: int, h: np.ndarray, there: np.ndarray) -> None:
        h = (h + np.uint64(kind)) * np.uint64(0xFF51AFD7ED558CCD)
        out.append(np.where(there, (h >> np.uint64(40)) % np.uint64(WEIGHTS), np.uint64(WEIGHTS)).astype(np.int64))

    power = np.cumprod(np.full(int(size.max()), prime))
    put(1, np.add.reduceat(code * power[np.arange(len(code)) - np.repeat(start, size)], start), size > 0)
    put(2, np.minimum(size, 12).astype(np.uint64), size > 0)
    for kind, most, at in ((10, 8, lambda k: start + k), (30, 6, lambda k: start + size - 1 - k)):
        h = np.zeros(len(words), dtype=np.uint64)
        for k in range(most):
            h = h * prime + code[np.clip(at(k), 0, len(code) - 1)]
            if k:
                put(kind + k, h, size > k + 1)
    return np.stack(out, axis=1)


# ------------------------------------------------------- forward-backward

def _scan(gain: np.ndarray, fresh: np.ndarray, move: np.ndarray, begin: float) -> np.ndarray:
    """Ratios r[t] = gain[t] * (m01 + m11 r) / (m00 + m10 r) with r the ratio before,
    or gain[t] * begin where ``fresh``. The row is cut into equal columns that are run
    side by side: first each column's transfer matrix, then the ratios themselves."""
    n = len(gain)
    rows = max(1, int(math.sqrt(n / 4)))
    cols = -(-n // rows)
    g = np.ones(rows * cols)
    g[:n] = gain
    f = np.zeros(rows * cols, dtype=bool)
    f[:n] = fresh
    f[0] = True
    g, f = np.ascontiguousarray(g.reshape(cols, rows).T), np.ascontiguousarray(f.reshape(cols, rows).T)
    m00, m01, m10, m11 = move.ravel()
    a, b, c, d = np.ones(cols), np.zeros(cols), np.zeros(cols), np.ones(cols)
    for t in range(rows):
        up = np.where(f[t], 0.0, m11)
        over = np.where(f[t], begin, m01)
        back = np.where(f[t], 0.0, m10)
        stay = np.where(f[t], 1.0, m00)
        a, b, c, d = g[t] * (up * a + over * c), g[t] * (up * b + over * d), back * a + stay * c, back * b + stay * d
        size = a + b + c + d
        a, b, c, d = a / size, b / size, c / size, d / size
    enter, r = np.empty(cols), 1.0
    for k, (ka, kb, kc, kd) in enumerate(zip(a.tolist(), b.tolist(), c.tolist(), d.tolist())):
        enter[k] = r
        r = (ka * r + kb) / (kc * r + kd)
    out, r = np.empty((rows, cols)), enter
    for t in range(rows):
        r = out[t] = g[t] * np.where(f[t], begin, (m01 + m11 * r) / (m00 + m10 * r))
    return out.T.ravel()[:n]


def marginals(emission: np.ndarray, first: np.ndarray, move: np.ndarray, begin: float) -> tuple[np.ndarray, np.ndarray]:
    """Probability of the toxic state per token, and per step into a token (not
    the first) the probabilities of the four state pairs. ``emission``: log gain of
    the toxic state; ``first``: tokens that begin a document; ``move``: weights
    [from, to]; ``begin``: weight of beginning toxic."""
    gain = np.exp(np.clip(emission, -30, 30))
    ahead = _scan(gain, first, move, begin)
    # backward: what follows a token weighs its two states as 1 to (m10 + m11 x) / (m00 + m01 x), x = gain * behind
    last = np.roll(first, -1)
    last[-1] = True
    x = _scan(gain[::-1], last[::-1], move.T, 1.0)[::-1]        # x[t] = gain[t] * behind[t]
    odds = ahead * (x / gain)
    p = odds / (1 + odds)
    t = np.flatnonzero(~first)
    before, here = ahead[t - 1], x[t]
    pairs = np.stack([move[0, 0] * np.ones(len(t)), move[0, 1] * here, move[1, 0] * before, move[1, 1] * before * here])
    return p, pairs / pairs.sum(axis=0)


class Tagger:
    """Emission weights, transitions and the logistic map."""

    def __init__(self):
        self.key = uuid.uuid4().hex
        self.weights = np.zeros(WEIGHTS + 1, dtype=np.float32)     # the last stays 0
        self.bias, self.move, self.begin = -5.0, np.ones((2, 2)), 1.0
        self.map = (0.0, 0.0, 0.0)
        self.fitted = False

    def emissions(self, words: list[str]) -> np.ndarray:
        if not words:
            return np.empty(0)
        return self.weights[word_features(words)].sum(axis=1, dtype=np.float64) + self.bias

    def tag(self, texts: list[str], memory: Memory | None = None) -> list[tuple[float, float, list[tuple[int, int, float]]]]:
        """Per text: largest marginal, expected toxic tokens, spans (start, end, marginal)."""
        tokens = [_TOKEN.findall(t) for t in texts]
        memory = memory or Memory(MEMO)
        new = memory.need(chain.from_iterable(tokens))
        known = memory.young
        known.update(zip(new, self.emissions(new).tolist()))
        sizes = np.array([len(ws) for ws in tokens], dtype=np.int64)
        if not sizes.sum():
            return [(0.0, 0.0, []) for _ in texts]
        emission = np.fromiter(map(known.__getitem__, chain.from_iterable(tokens)), dtype=np.float64, count=int(sizes.sum()))
        memory.turn()
        starts = np.cumsum(sizes) - sizes
        first = np.zeros(len(emission), dtype=bool)
        first[starts[sizes > 0]] = True
        p, _ = marginals(emission, first, self.move, self.begin)
        out = []
        for t, at, n in zip(texts, starts.tolist(), sizes.tolist()):
            own = p[at:at + n]
            spans = []
            if n and own.max() >= 0.5:
                spans = [(m.start(), m.end(), float(q)) for m, q in zip(_TOKEN.finditer(t), own) if q >= 0.5]
            out.append((float(own.max()) if n else 0.0, float(own.sum()), spans))
        return out

    def score(self, top: float, expected: float) -> float:
        if not self.fitted:
            return 0.0
        a, b, c = self.map
        top = min(max(top, 1e-9), 1 - 1e-9)
        z = a + b * math.log(top / (1 - top)) + c * math.log1p(expected)
        return 1 / (1 + math.exp(-min(max(z, -30.0), 30.0)))


def _token_labels(docs: list[np.ndarray], toxic: np.ndarray, ids: np.ndarray) -> list[np.ndarray]:
    """0/1 per token of every document (places of its words in ``ids``) from the documents' labels."""
    pos, neg = np.zeros(WEIGHTS + 1), np.zeros(WEIGHTS + 1)
    for ws, y in zip(docs, toxic):
        (pos if y else neg)[np.unique(ids[np.unique(ws)])] += 1
    n1, n0 = toxic.sum(), len(toxic) - toxic.sum()
    bound = (np.log((pos + 0.5) / (n1 + 1)) - np.log((neg + 0.5) / (n0 + 1)) - np.sqrt(1 / (pos + 0.5) + 1 / (neg + 0.5)))
    bound[WEIGHTS] = -np.inf
    best = bound[ids].max(axis=1)
    out = []
    for ws, y in zip(docs, toxic):
        s = best[ws]
        mark = s >= CLEAR
        if y and len(s) and not mark.any():
            mark = (s == s.max()) & (s > 0)
        out.append(mark & bool(y))
    return out


def _fit_chain(tagger: Tagger, docs: list[np.ndarray], y: np.ndarray, use: np.ndarray, ids: np.ndarray) -> None:
    """Set the tagger's weights from the documents at ``use`` (both kinds, some with tokens)."""
    labels = _token_labels([docs[i] for i in use], y[use], ids)
    clean = [k for k, i in enumerate(use) if not y[i]][:CHAIN_CLEAN]
    chosen = [k for k in [*np.flatnonzero(y[use]), *clean] if len(docs[use[k]])]
    if not chosen:
        return
    token = np.concatenate([docs[use[k]] for k in chosen])
    mark = np.concatenate([labels[k] for k in chosen]).astype(np.float64)
    sizes = np.array([len(docs[use[k]]) for k in chosen])
    first = np.zeros(len(token), dtype=bool)
    first[np.cumsum(sizes) - sizes] = True
    own, token = np.unique(token, return_inverse=True)
    ids = ids[own]

    w, bias, log_move, log_begin = np.zeros(WEIGHTS + 1), -5.0, np.zeros((2, 2)), 0.0
    step = np.flatnonzero(~first)
    seen = np.bincount((2 * mark[step - 1] + mark[step]).astype(int), minlength=4)
    mean, square = np.zeros(WEIGHTS + 7), np.zeros(WEIGHTS + 7)
    for k in range(1, STEPS + 1):
        by_word = w[ids].sum(axis=1) + bias
        p, pairs = marginals(by_word[token], first, np.exp(log_move), math.exp(log_begin))
        miss = np.bincount(token, weights=mark - p, minlength=len(own))
        grad = np.concatenate([np.bincount(ids.ravel(), weights=np.repeat(miss, ids.shape[1]), minlength=WEIGHTS + 1) - 0.05 * w,
                               [miss.sum()], (seen - pairs.sum(axis=1)) - 0.05 * log_move.ravel(),
                               [(mark - p)[first].sum() - 0.05 * log_begin]])
        mean, square = 0.8 * mean + 0.2 * grad, 0.95 * square + 0.05 * grad ** 2
        move = 0.25 * (mean / (1 - 0.8 ** k)) / (np.sqrt(square / (1 - 0.95 ** k)) + 0.5)
        w, bias = w + move[:WEIGHTS + 1], bias + move[WEIGHTS + 1]
        w[WEIGHTS] = 0
        log_move = log_move + move[WEIGHTS + 2:WEIGHTS + 6].reshape(2, 2)
        log_begin += move[-1]
    tagger.weights, tagger.bias = w.astype(np.float32), bias
    tagger.move, tagger.begin = np.exp(log_move), math.exp(log_begin)


def _logistic(x: np.ndarray, z: np.ndarray) -> tuple[float, ...]:
    """Newton steps; a coefficient under 0 is left out, as more evidence must not lower a score."""
    use = [0, 1, 2]
    while True:
        xs, beta = x[:, use], np.zeros(len(use))
        ridge = np.diag([1e-3, *[1e-2] * (len(use) - 1)])
        for _ in range(30):
            q = 1 / (1 + np.exp(-np.clip(xs @ beta, -30, 30)))
            beta = beta + np.linalg.solve((xs * (q * (1 - q))[:, None]).T @ xs + ridge, xs.T @ (z - q) - ridge @ beta)
        if len(use) < 3 or (beta[1:] >= 0).all():
            return tuple(float(beta[use.index(i)]) if i in use else 0.0 for i in range(3))
        use = [0, 1 if beta[1] > beta[2] else 2]


def fit(texts: list[str], toxic: list[int]) -> Tagger:
    """Train on labelled documents, held by one task (the sample is bounded). The map
    is fitted on documents tagged by chains of the other ``FOLDS`` - 1 folds."""
    tagger = Tagger()
    y = np.array(toxic, dtype=bool)
    index: dict[str, int] = {}
    docs = [np.array([index.setdefault(w, len(index)) for w in _TOKEN.findall(t)], dtype=np.int64) for t in texts]
    if y.sum() < 2 * FOLDS or (~y).sum() < 2 * FOLDS or not index:
        return tagger
    ids = word_features(list(index))
    del index
    fold = np.empty(len(docs), dtype=np.int64)
    for kind in (y, ~y):                                    # as many of either kind in each
        fold[kind] = np.random.default_rng(7).permutation(int(kind.sum())) % FOLDS
    x, z = [], []
    for f in range(FOLDS):
        _fit_chain(tagger, docs, y, np.flatnonzero(fold != f), ids)
        held = np.flatnonzero(fold == f)
        for at in range(0, len(held), 200):
            for top, expected, _ in tagger.tag([texts[i] for i in held[at:at + 200]]):
                top = min(max(top, 1e-9), 1 - 1e-9)
                x.append((1.0, math.log(top / (1 - top)), math.log1p(expected)))
        z.append(y[held])
    tagger.map = _logistic(np.array(x), np.concatenate(z).astype(float))
    _fit_chain(tagger, docs, y, np.arange(len(docs)), ids)
    tagger.fitted = True
    return tagger


# ----------------------------------------------------------- the operator

def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Tagger:
    """Fit on a bounded sample of the labelled rows that are not held out."""
    known = (labels.select(labels["doc_id"].cast("long").alias("__id"), labels["toxic"].cast("int").alias("__y"))
             .where(F.col("__id").isNotNull() & F.col("__y").isin(0, 1) & ~held_out(F.col("__id")))
             .groupBy("__id").agg(F.max("__y").alias("__y")))
    texts = docs.select(docs[id_col].cast("long").alias("__id"), docs[text_col].cast("string").alias("__t")).where(
        F.length("__t") <= TRAIN_CHARS)
    order = [F.xxhash64("__id"), F.col("__id")]
    sample = []
    for y, n in ((1, TRAIN_TOXIC), (0, TRAIN_CLEAN)):
        chosen = known.where(F.col("__y") == y).orderBy(*order).limit(2 * n)     # some have no text or a long one
        sample.append(texts.join(F.broadcast(chosen), "__id").orderBy(*order).limit(n).select("__t", "__y"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # by a hash of the text: the chain's clean documents are the first of the order
        rows = sorted((y, zlib.crc32(t.encode()), t) for b in batches
                      for t, y in zip(b.column("__t").to_pylist(), b.column("__y").to_pylist()))
        tagger = fit([t for _, _, t in rows], [y for y, _, _ in rows])
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(tagger)], pa.binary())], ["model"])

    # one task fits the bounded sample, away from the driver; only the weights come back
    small_batches(docs.sparkSession)
    row = sample[0].unionByName(sample[1]).coalesce(1).mapInArrow(forgetting(run), "model binary").first()
    return pickle.loads(row["model"]) if row else Tagger()


RESULT = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("spans", T.ArrayType(T.StructType([
    T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("p", T.DoubleType())])))])
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))


def scorer(docs: DataFrame, tagger: Tagger):
    """A column function: text -> struct(score, spans)."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(tagger)       # WEIGHTS numbers, whatever the corpus

    def score(texts: Iterable[pa.Array]) -> Iterator[pa.Array]:
        model, memory = shared.value, Memory(MEMO)
        for text in texts:
            got = model.tag([t or "" for t in text.to_pylist()], memory)
            yield pa.StructArray.from_arrays(
                [pa.array([model.score(t, e) for t, e, _ in got], pa.float64()),
                 pa.array([[{"start": a, "end": b, "p": q} for a, b, q in s] for _, _, s in got], _SPANS)], ["score", "spans"])

    @F.arrow_udf(RESULT)
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from forgetting(score)(texts)

    return run


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted, spans of every row."""
    run = scorer(docs, train(docs, labels, id_col, text_col))
    return (docs.select(docs[id_col].cast("long").alias("doc_id"), run(docs[text_col].cast("string")).alias("__s"))
            .select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("__s.score").alias("score"),
                    (F.col("__s.score") >= THRESHOLD).cast("int").alias("predicted"), F.col("__s.spans").alias("spans")))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows with a score under the threshold, all their columns, whatever their names."""
    run = scorer(docs, train(docs, labels, id_col, text_col))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), run(docs[text_col].cast("string")).alias("s"))
    return rows.where(F.col("s.score") < THRESHOLD).select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
