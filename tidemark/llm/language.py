"""Language identification: averaged hashed subword embeddings with a linear softmax.

A text's subwords are its 3- and 4-byte runs that lie in one word, word edges included. Each is hashed to a
row of an embedding table; the average of a text's rows goes through a linear softmax. Table and softmax
are learned together by stochastic gradient descent in numpy, on a bounded sample of labelled rows. A
temperature is then fitted on held-back rows of the sample, and a text is rejected when its calibrated
score is below what all but a small share of those rows reach.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import parts, pieces

BUCKETS = 1 << 14
GRAMS = (3, 4)


@dataclass
class LanguageModel:
    labels: list[str]
    table: np.ndarray  # BUCKETS x labels: embeddings times softmax weights
    bias: np.ndarray
    temperature: float
    least: float


def subwords(data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Buckets of the subwords and the offsets of the texts into them, for each length."""
    fold = np.arange(256, dtype=np.uint32)
    fold[65:91] += 32
    fold[: 65] = 32
    fold[91:97] = 32
    fold[123:128] = 32
    n = len(offsets) - 1
    # each text gets a space before and after, so that runs never cross texts
    codes = np.full(len(data) + 2 * n, 32, np.uint32)
    shift = np.repeat(2 * np.arange(n) + 1, np.diff(offsets))
    codes[np.arange(len(data)) + shift] = fold[data]
    edges = offsets + 2 * np.arange(n + 1)
    space = codes == 32
    out = []
    for k in GRAMS:
        m = len(codes) - k + 1
        if m <= 0:
            out.append((np.zeros(0, np.int64), np.zeros(n + 1, np.int64)))
            continue
        ok = ~space[1 : m + 1]
        for j in range(2, k - 1):
            ok &= ~space[j : m + j]
        key = np.zeros(m, np.uint32)
        for j in range(k):
            key = key * np.uint32(0x01000193) + codes[j : m + j]
        at = np.flatnonzero(ok)
        key = key[at]
        key = (key ^ (key >> np.uint32(15))) * np.uint32(0x2C1B3C6D + 2 * k)
        out.append(((key >> np.uint32(18)).astype(np.int64), np.searchsorted(at, edges)))
    return out


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def _featurize(batches):
    for batch in batches:
        for rows, data, offsets in pieces(batch, "text"):
            both = subwords(data, offsets)
            keys, counts = [], []
            for i in range(rows.num_rows):
                own = np.concatenate([g[at[i] : at[i + 1]] for g, at in both])
                k, c = np.unique(own, return_counts=True)
                keys.append(k.astype(np.int32))
                counts.append((c / max(1, len(own))).astype(np.float32))
            yield pa.RecordBatch.from_arrays(
                [rows.column(rows.schema.get_field_index("h")), rows.column(rows.schema.get_field_index("label")), pa.array(keys, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.float32()))],
                names=["h", "label", "keys", "shares"])


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(docs: DataFrame, label: str = "lang", id_col: str = "doc_id", text: str = "text", sample_rows: int = 2000, size: int = 16, epochs: int = 12, rate: float = 2.0, reject: float = 0.002, seed: int = 7) -> LanguageModel:
    """Learn from at most ``sample_rows`` rows with a label, chosen by a hash of their id; only text and label are inputs. A table without such rows gives a model that knows no language."""
    usable = docs.filter(F.col(label).isNotNull())
    n = usable.count()
    share = min(1.0, 0.9 * sample_rows / max(1, n))
    picked = usable.filter(F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(1_000_000)) < int(share * 1_000_000)) if n > sample_rows else usable
    rows = picked.select(F.xxhash64(id_col, text).alias("h"), F.col(label).cast("string").alias("label"), F.col(text).cast("string").alias("text"))
    # in an order that does not depend on how the table is laid out
    rows = rows.mapInArrow(_featurize, "h long, label string, keys array<int>, shares array<float>").orderBy("h", "label").limit(sample_rows).toPandas()
    rows = rows[rows["keys"].map(len) > 0]
    labels = sorted(set(rows["label"]))
    if not labels:
        return LanguageModel([], np.zeros((BUCKETS, 0)), np.zeros(0), 1.0, 0.0)
    rng = np.random.default_rng(seed)
    y = np.array([labels.index(x) for x in rows["label"]])
    keys, shares = ([np.asarray(x) for x in rows[c]] for c in ("keys", "shares"))
    order = rng.permutation(len(y))
    held, own = order[: len(y) // 5], order[len(y) // 5 :]
    table = rng.normal(0, 0.1, (BUCKETS, size))
    weights, bias = rng.normal(0, 0.1, (size, len(labels))), np.zeros(len(labels))
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for i in rng.permutation(own):
            x = shares[i] @ table[keys[i]]
            error = _softmax(x @ weights + bias)
            error[y[i]] -= 1
            back = weights @ error
            weights -= 0.1 * step * np.outer(x, error)
            bias -= 0.1 * step * error
            table[keys[i]] -= step * 10 * shares[i][:, None] * back
    full = table @ weights
    z = np.array([shares[i] @ full[keys[i]] + bias for i in held]).reshape(-1, len(labels))
    temperature, least = 1.0, 0.0
    if len(held):
        t = np.exp(np.linspace(-2, 3, 61))
        loss = [-np.log(np.maximum(_softmax(z / x)[np.arange(len(held)), y[held]], 1e-12)).mean() for x in t]
        temperature = float(t[int(np.argmin(loss))])
        right = _softmax(z / temperature).max(axis=1)[z.argmax(axis=1) == y[held]]
        least = float(np.quantile(right, reject)) if len(right) else 0.0
    return LanguageModel(labels, full, bias, temperature, least)


def _predict(shared):
    def run(batches):
        model = LanguageModel(**shared.value)
        table = [np.ascontiguousarray(c, dtype=np.float32) for c in model.table.T]
        labels = np.array([*model.labels, "und"], dtype=object)
        for batch in batches:
            n = batch.num_rows
            letters = batch.column(batch.schema.get_field_index("letters")).to_numpy(zero_copy_only=False).astype(bool)
            z, count = np.zeros((n, len(table))), np.zeros(n)
            for row, data, offsets in parts(batch, "text"):
                both = subwords(data, offsets)
                count[row] += sum(np.diff(at) for _, at in both)
                for c, column in enumerate(table):
                    for g, at in both:
                        z[row, c] += _sums(column[g], at)
            p = _softmax((z / np.maximum(count, 1)[:, None] + model.bias) / model.temperature) if len(table) else np.zeros((n, 1))
            score = np.where(letters, p.max(axis=1), 0.0) if len(table) else np.zeros(n)
            pick = np.where(letters, p.argmax(axis=1), len(model.labels)) if len(table) else np.zeros(n, int)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(labels[pick], pa.string()), pa.array(score), pa.array(~letters | (score < model.least))],
                names=["id", "lang_pred", "score", "rejected"])

    return run


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``id_col, lang_pred, score, rejected`` for every row.

    A null text, one without letters, and every text where nothing could be learned get ``und`` with score 0.
    ``rejected`` marks these and texts whose calibrated score is below the model's limit. Rows that repeat get equal
    results, other columns are ignored, an empty table gives no rows. A long text is averaged over its parts, cut
    after a space where one is near. The model is of a fixed size and is broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))
    rows = docs.select(
        F.col(id_col).alias("id"), F.col(text).cast("string").alias("text"), F.coalesce(F.rlike(F.col(text), F.lit(r"\p{L}")), F.lit(False)).alias("letters"))
    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(_predict(shared), f"id {kind}, lang_pred string, score double, rejected boolean").withColumnRenamed("id", id_col)
