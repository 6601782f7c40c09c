"""Quality classifier: random-indexing word vectors pooled by document, then a two-layer network in numpy.

Tokens are stretches of small letters, of capitals, of digits and of other signs; white space parts them.
Random indexing: each token has a fixed sparse random index vector, and its context vector is the sum of
its neighbours' index vectors over the whole corpus. Tokens share ``BUCKETS`` hashed rows, so the table
has one size whatever the corpus. A document is pooled to the mean and the deviation of its tokens'
vectors and the mean step between neighbours; a network of one hidden layer gives a probability, whose
temperature is fitted on held-back rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh
from .text import hash_words, mix, parts

BUCKETS, SIZE, MARKS = 1 << 14, 24, 2
PIECE = 700_000  # bytes of text whose token vectors are held at once


@dataclass
class QualityModel:
    vectors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float


class Tokens:
    """Hashed tokens of texts and the n + 1 offsets of the texts into them."""

    def __init__(self) -> None:
        kind = np.full(256, 4, np.uint8)  # other signs
        kind[[9, 10, 11, 12, 13, 32]] = 0
        kind[97:123] = kind[128:] = 1
        kind[65:91] = 2
        kind[48:58] = 3
        self.kind = kind

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(data)
        if not n:
            return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
        kind = self.kind[data]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        edge[1:n] |= kind[1:] != kind[:-1]
        edge[0] = edge[n] = True
        cuts = np.flatnonzero(edge)
        full = kind[cuts[:-1]] != 0
        starts, ends = cuts[:-1][full], cuts[1:][full]
        h = hash_words(data, starts, ends)
        return (h % np.uint64(BUCKETS)).astype(np.int64), np.searchsorted(starts, offsets)


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of each bucket's MARKS marks."""
    h = mix(np.arange(BUCKETS * MARKS, dtype=np.uint64) + np.uint64(12345)).reshape(BUCKETS, MARKS)
    return (h % np.uint64(SIZE)).astype(np.int64), np.where(h >> np.uint64(63), 1.0, -1.0)


def _contexts(batches):
    tokens, (place, sign) = Tokens(), index_vectors()
    total, seen = np.zeros(BUCKETS * SIZE), np.zeros(BUCKETS, bool)
    for batch in batches:
        for _, data, offsets in parts(batch, "text"):
            t, at = tokens(data, offsets)
            if len(t) < 2:
                continue
            own = np.repeat(np.arange(len(at) - 1), np.diff(at))
            i = np.flatnonzero(own[1:] == own[:-1])
            for a, b in ((t[i], t[i + 1]), (t[i + 1], t[i])):
                for m in range(MARKS):
                    total += np.bincount(a * SIZE + place[b, m], weights=sign[b, m], minlength=BUCKETS * SIZE)
            seen[t] = True
    rows = np.flatnonzero(seen)
    table = total.reshape(BUCKETS, SIZE)[rows]
    yield pa.RecordBatch.from_arrays([pa.array(rows), *(pa.array(np.ascontiguousarray(c)) for c in table.T)], names=["bucket", *(f"v{j}" for j in range(SIZE))])


def word_vectors(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Context vectors of all buckets over every row of docs, at length 1: BUCKETS x SIZE, whatever the corpus."""
    parts = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(_contexts, "bucket long, " + ", ".join(f"v{j} double" for j in range(SIZE)))
    rows = parts.groupBy("bucket").agg(*(F.sum(f"v{j}").alias(f"v{j}") for j in range(SIZE))).toPandas()
    table = np.zeros((BUCKETS, SIZE))
    table[rows["bucket"].to_numpy(np.int64)] = rows[[f"v{j}" for j in range(SIZE)]].to_numpy(float)
    return (table / np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def sums(t: np.ndarray, at: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """For each text the number of its tokens, then the sums of their vectors, of the squares and of the steps between neighbours."""
    n = np.diff(at)
    full = np.flatnonzero(n)
    out = np.zeros((len(n), 1 + 3 * SIZE))
    out[:, 0] = n
    if len(full):
        v = vectors[t]
        begin = at[:-1][full]
        step = np.zeros_like(v)
        step[1:] = np.abs(v[1:] - v[:-1])
        step[begin] = 0
        out[full, 1:] = np.hstack([np.add.reduceat(x, begin, axis=0) for x in (v, v * v, step)])
    return out


def pool(batch: pa.RecordBatch, text: str, tokens: Tokens, vectors: np.ndarray) -> np.ndarray:
    """Mean, deviation and mean step of each text's token vectors; zeros for a text without tokens. A long text's parts add up."""
    total = np.zeros((batch.num_rows, 1 + 3 * SIZE))
    for row, data, offsets in parts(batch, text, PIECE):
        total[row] += sums(*tokens(data, offsets), vectors)
    mean, square, step = np.split(total[:, 1:] / np.maximum(total[:, :1], 1), 3, axis=1)
    return np.hstack([mean, np.sqrt(np.maximum(square - mean * mean, 0)), step]).astype(np.float32)


def _features(shared):
    def run(batches):
        tokens, vectors = Tokens(), shared.value
        for batch in batches:
            x = pool(batch, "text", tokens, vectors)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(x), pa.list_(pa.float32()))], names=["h", "label", "x"])

    return run


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text: str = "text", vectors: np.ndarray | None = None, sample_rows: int = 8000, hidden: int = 24, epochs: int = 40, rate: float = 0.05, seed: int = 7) -> QualityModel:
    """Learn from at most ``sample_rows`` labelled rows, chosen by a hash of their id.

    Word vectors come from every row of docs, unless given. Rows whose label is null are left out; where one
    document has two labels it counts twice. The network's inputs are pooled vectors only.
    """
    spark = docs.sparkSession
    vectors = word_vectors(docs, text) if vectors is None else vectors
    known = labels.filter(F.col(label).isNotNull()).select(F.col(id_col).alias("_id"), F.col(label).cast("int").alias("label"))
    n = known.count()
    if n > sample_rows:
        known = known.filter(F.pmod(F.xxhash64("_id", F.lit(seed)), F.lit(1_000_000)) < int(0.9 * sample_rows / n * 1_000_000))
    # at most sample_rows ids and labels are broadcast
    source = docs.select(F.col(id_col).alias("_doc"), F.col(text).cast("string").alias("text"))
    rows = source.join(F.broadcast(known.orderBy(F.xxhash64("_id", F.lit(seed)), "label").limit(sample_rows)), F.col("_doc") == F.col("_id")).select(F.xxhash64("_id", "text").alias("h"), "label", "text")
    shared = spark.sparkContext.broadcast(vectors)
    # in an order that does not depend on how the tables are laid out
    data = rows.mapInArrow(_features(shared), "h long, label int, x array<float>").toPandas().sort_values(["h", "label"], kind="stable")
    width = 3 * SIZE
    if not len(data):
        return QualityModel(vectors, np.zeros(width), np.ones(width), np.zeros((width, hidden)), np.zeros(hidden), np.zeros(hidden), 0.0, 1.0)
    x, y = np.stack(data["x"]).astype(float), data["label"].to_numpy(float)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    held, own = order[: len(y) // 5], order[len(y) // 5 :]
    mean, scale = x[own].mean(axis=0), x[own].std(axis=0) + 1e-3
    z = np.clip((x - mean) / scale, -8, 8)
    w1, b1 = rng.normal(0, 1 / np.sqrt(width), (width, hidden)), np.zeros(hidden)
    w2, b2 = rng.normal(0, 1 / np.sqrt(hidden), hidden), 0.0
    share = np.clip(y[own].mean(), 0.02, 0.98)
    weight = np.where(y == 1, 0.5 / share, 0.5 / (1 - share)) ** 0.5  # the rarer label counts more, by the root of its rarity
    velocity = [np.zeros_like(w1), np.zeros_like(b1), np.zeros_like(w2), 0.0]
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for part in np.array_split(rng.permutation(own), max(1, len(own) // 32)):
            a = np.tanh(z[part] @ w1 + b1)
            p = 1 / (1 + np.exp(-(a @ w2 + b2)))
            d = (p - y[part]) * weight[part] / len(part)
            back = np.outer(d, w2) * (1 - a * a)
            grads = [z[part].T @ back + 1e-4 * w1, back.sum(axis=0), a.T @ d + 1e-4 * w2, float(d.sum())]
            velocity = [0.9 * v - step * g for v, g in zip(velocity, grads, strict=True)]
            w1, b1, w2, b2 = w1 + velocity[0], b1 + velocity[1], w2 + velocity[2], b2 + velocity[3]
    temperature = 1.0
    if len(held):
        logit = np.tanh(z[held] @ w1 + b1) @ w2 + b2
        t = np.exp(np.linspace(-1.5, 2.5, 61))
        sign = np.where(y[held] == 1, 1.0, -1.0)
        temperature = float(t[int(np.argmin([np.logaddexp(0, -sign * logit / v).mean() for v in t]))])
    return QualityModel(vectors, mean, scale, w1, b1, w2, float(b2), temperature)


def probability(model: QualityModel, x: np.ndarray) -> np.ndarray:
    z = np.clip((x - model.mean) / model.scale, -8, 8)
    return 1 / (1 + np.exp(-np.clip((np.tanh(z @ model.w1 + model.b1) @ model.w2 + model.b2) / model.temperature, -40, 40)))


def _score(shared, at: int, name: str):
    def run(batches):
        tokens, model = Tokens(), QualityModel(**shared.value)
        for batch in batches:
            texts = pa.RecordBatch.from_arrays([batch.column(at)], names=["text"])
            score = pa.array(probability(model, pool(texts, "text", tokens, model.vectors)), pa.float64())
            columns = [batch.column(i) for i in range(at)] + [score]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:at], name])

    return run


def score_quality(docs: DataFrame, model: QualityModel, text: str = "text", keep: list[str] | None = None, name: str = "score") -> DataFrame:
    """The columns ``keep`` of every row of docs (all by default) and ``name``, the probability of label 1.

    A null or empty text is scored as one without tokens; rows that repeat get equal scores; an empty table gives no
    rows. A long text is pooled over its parts, cut after a space where one is near. A kept column of that name is
    replaced. The model has a fixed size and is broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))
    kept = docs.select(*(c for c in (keep if keep is not None else docs.columns) if c != name))
    source = docs.select(*kept.columns, F.col(text).cast("string").alias(fresh("_text", kept.columns)))
    schema = T.StructType([*kept.schema.fields, T.StructField(name, T.DoubleType())])
    return source.mapInArrow(_score(shared, len(kept.columns), name), schema)
