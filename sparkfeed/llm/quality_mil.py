"""Quality classifier by attention-based multiple-instance learning.

A text is a bag of passages. Every passage is encoded; gated attention, learned from the labels of
whole texts, weighs the passages; the weighted sum is scored. Only the small model is trained on
the driver, from a sample with a fixed bound; texts are encoded and scored where they are.
"""

from __future__ import annotations

import re
import warnings
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import bounded, col, field_type, hold_only, slices, strings

PASSAGE_WORDS = 64
BUCKETS = 96
#: Bounds of the training sample: labelled texts, and passages of all of them together.
SAMPLE_TEXTS, SAMPLE_PASSAGES = 4000, 60_000
THRESHOLD = 0.7
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_OWN = 8  # measures of a word
_DENSE = 12
SIZE = BUCKETS + _DENSE


class _Words:
    """word -> row of a table of its measures; begins anew when full."""

    def __init__(self, most: int = 100_000):
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.table = np.zeros((4096, _OWN), np.float32)
        self.bucket = np.zeros(4096, np.int64)
        self.sign = np.zeros(4096, np.float32)

    def _add(self, word: str) -> int:
        k = len(self.place)
        if k >= len(self.table):
            self.table, self.bucket, self.sign = (np.concatenate([x, np.zeros_like(x)]) for x in (self.table, self.bucket, self.sign))
        h = xxhash.xxh3_64_intdigest(word.lower())
        letters = sum(map(str.isalpha, word))
        self.bucket[k], self.sign[k] = h % BUCKETS, 1.0 if h >> 63 else -1.0
        self.table[k] = (
            min(len(word), 40) / 8, len(word) <= 3, len(word) > 12, (len(word) - letters) / len(word), letters == 0,
            len(word) > 1 and letters > 0 and word.isupper(), any(map(str.isdigit, word)), word[-1] in ".!?",
        )
        self.place[word] = k
        return k

    def rows(self, words: list[str]) -> np.ndarray:
        get, add = self.place.get, self._add
        out = np.empty(len(words), np.int64)
        for i, w in enumerate(words):
            k = get(w)
            out[i] = add(w) if k is None else k
        return out


_words = _Words()


def encode_passages(texts: list[str], passage_words: int = PASSAGE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage of every text, and each passage's text. A text without words has
    one passage of zeros."""
    hold_only("mil", _words.clear)
    if len(_words.place) > _words.most:
        _words.clear()
    parts = [_WORD.findall(t) for t in texts]
    counts = np.array([len(p) for p in parts])
    bags = np.maximum(1, -(-counts // passage_words))
    owner = np.repeat(np.arange(len(texts)), bags)
    first = np.concatenate([[0], np.cumsum(bags)[:-1]])
    rows = np.concatenate([_words.rows(p) for p in parts]) if counts.sum() else np.empty(0, np.int64)
    at = np.concatenate([first[k] + np.arange(n) // passage_words for k, n in enumerate(counts)]) if counts.sum() else np.empty(0, np.int64)
    passages = int(bags.sum())
    n = np.bincount(at, minlength=passages).astype(np.float32)
    some = np.maximum(n, 1)[:, None]
    x = np.zeros((passages, SIZE), np.float32)
    if len(rows):
        hashed = np.bincount(at * BUCKETS + _words.bucket[rows], weights=_words.sign[rows], minlength=passages * BUCKETS).reshape(passages, BUCKETS)
        x[:, :BUCKETS] = hashed / np.sqrt(some)
        for k in range(_OWN):
            x[:, BUCKETS + k] = np.bincount(at, weights=_words.table[rows, k], minlength=passages) / some[:, 0]
        pair = np.unique(at * (len(_words.place) + 1) + rows)
        x[:, BUCKETS + _OWN] = 1 - np.bincount(pair // (len(_words.place) + 1), minlength=passages) / some[:, 0]
        same = rows[1:] == rows[:-1]
        same &= at[1:] == at[:-1]
        x[:, BUCKETS + _OWN + 1] = np.bincount(at[1:][same], minlength=passages) / some[:, 0]
    x[:, BUCKETS + _OWN + 2] = np.log1p(n) / 4
    x[:, BUCKETS + _OWN + 3] = (np.log1p(counts)[owner]) / 8
    return x, owner


@dataclass
class Model:
    """Encoder ``w, b``; gated attention ``v, u, a``; classifier ``c, d``; means and scales of features."""

    mean: np.ndarray
    scale: np.ndarray
    p: dict[str, np.ndarray]

    def scores(self, x: np.ndarray, owner: np.ndarray, texts: int) -> np.ndarray:
        return _forward(self.p, (x - self.mean) / self.scale, owner, texts)[-1]


def _forward(p: dict, x: np.ndarray, owner: np.ndarray, texts: int) -> tuple:
    h = np.tanh(x @ p["w"] + p["b"])
    t, g = np.tanh(h @ p["v"]), 1 / (1 + np.exp(-(h @ p["u"])))
    e = np.clip((t * g) @ p["a"], -30, 30)
    e = np.exp(e)
    att = e / np.bincount(owner, weights=e, minlength=texts)[owner]
    starts = np.concatenate([[0], np.flatnonzero(np.diff(owner)) + 1])
    z = np.add.reduceat(att[:, None] * h, starts, axis=0)
    y = 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"], -30, 30)))
    return h, t, g, att, z, y


def train(x: np.ndarray, owner: np.ndarray, y: np.ndarray, hidden: int = 24, gate: int = 12, epochs: int = 40, batch: int = 128, rate: float = 0.01, decay: float = 1e-4, seed: int = 7) -> Model:
    """Adam on the log loss of the bags' labels. With no bags or one class, scores are that class's share."""
    rng = np.random.default_rng(seed)
    mean, scale = (x.mean(axis=0), x.std(axis=0) + 0.05) if len(x) else (np.zeros(SIZE), np.ones(SIZE))
    mean, scale = mean.astype(np.float32), scale.astype(np.float32)
    f = x.shape[1] if len(x) else SIZE
    p = {
        "w": rng.normal(0, f**-0.5, (f, hidden)), "b": np.zeros(hidden), "v": rng.normal(0, hidden**-0.5, (hidden, gate)), "u": rng.normal(0, hidden**-0.5, (hidden, gate)),
        "a": rng.normal(0, gate**-0.5, gate), "c": rng.normal(0, hidden**-0.5, hidden), "d": np.zeros(1),
    }
    bags = len(y)
    share = (y.sum() + 1) / (bags + 2)
    p["d"][:] = np.log(share / (1 - share))
    if bags == 0 or y.min() == y.max():
        return Model(mean, scale, {k: v * (0 if k == "c" else 1) for k, v in p.items()})
    x = (x - mean) / scale
    starts = np.concatenate([np.flatnonzero(np.diff(owner, prepend=-1)), [len(owner)]])
    m1, m2, step = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
    for epoch in range(epochs):
        order = rng.permutation(bags)
        for at in range(0, bags, batch):
            some = order[at : at + batch]
            rows = np.concatenate([np.arange(starts[k], starts[k + 1]) for k in some])
            own = np.repeat(np.arange(len(some)), starts[some + 1] - starts[some])
            xb = x[rows]
            h, t, g, att, z, out = _forward(p, xb, own, len(some))
            dl = (out - y[some]) / len(some)
            grad = {"c": z.T @ dl, "d": np.array([dl.sum()])}
            dz = dl[:, None] * p["c"]
            da = (dz[own] * h).sum(axis=1)
            de = att * (da - np.bincount(own, weights=att * da, minlength=len(some))[own])
            grad["a"] = (t * g).T @ de
            dtg = de[:, None] * p["a"]
            dt, dg = dtg * g * (1 - t * t), dtg * t * g * (1 - g)
            grad["v"], grad["u"] = h.T @ dt, h.T @ dg
            dh = (att[:, None] * dz[own] + dt @ p["v"].T + dg @ p["u"].T) * (1 - h * h)
            grad["w"], grad["b"] = xb.T @ dh, dh.sum(axis=0)
            step += 1
            now = rate * (0.5 + 0.5 * np.cos(np.pi * epoch / epochs))
            for k, v in p.items():
                d = grad[k] + decay * v
                m1[k] = 0.9 * m1[k] + 0.1 * d
                m2[k] = 0.999 * m2[k] + 0.001 * d * d
                v -= now * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)
    return Model(mean, scale, {k: v.astype(np.float32) for k, v in p.items()})


def held_out(doc_id: Column) -> Column:
    """Whether a row's labels are kept from learning: crc32 of the id as text, mod 4, is 2."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 4 == 2


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_texts: int = SAMPLE_TEXTS, sample_passages: int = SAMPLE_PASSAGES) -> Model:
    """The model, learnt from labelled texts that are not held out.

    The first ``sample_texts`` labelled ids are taken in the order of a hash, and of them those whose
    passages fit, so the sample is the same at each run and its size the same at each scale. A text
    that no longer fits is left out, and those after it are still taken. Several labels of an id are
    averaged, null ones and null ids ignored; texts of a repeated id all count; empty tables give a
    model whose scores are all alike. Only ids are read to choose from,
    and only texts of chosen ids are split into words.
    """
    label = labels.where(col(label_col).isNotNull() & col(id_col).isNotNull() & ~held_out(col(id_col))).groupBy(col(id_col).alias("id")).agg(F.avg(col(label_col)).alias("y"))
    words = F.size(F.split(F.coalesce(col("text"), F.lit("")), r"[\x20\x09-\x0D]+"))
    source = docs.select(col(id_col).alias("id"), col(text_col).alias("text"))
    order = F.xxhash64(F.lit("mil"), F.col("id"))
    pair = T.StructType([T.StructField("id", field_type(docs, id_col)), T.StructField("y", T.DoubleType())])
    known = source.select("id").join(label, "id").groupBy("id", "y").agg(F.count("*").alias("n")).orderBy(order, "id").limit(sample_texts).select("id", "y").collect()
    some = docs.sparkSession.createDataFrame([(r["id"], float(r["y"])) for r in known], pair)
    counted = source.join(F.broadcast(some), "id").select("id", "y", F.ceil(words / PASSAGE_WORDS).alias("passages"))
    first = counted.groupBy("id", "y").agg(F.sum("passages").alias("passages")).orderBy(order, "id").collect()
    chosen, total = [], 0
    for r in first:
        if total + r["passages"] > sample_passages:
            continue
        total += r["passages"]
        chosen.append((r["id"], float(r["y"])))
    if len({y >= 0.5 for _, y in chosen}) < 2:
        warnings.warn("no labelled texts of both classes to learn from: all scores will be alike", stacklevel=2)
    picked = docs.sparkSession.createDataFrame(chosen, pair)
    schema = T.StructType([T.StructField("id", field_type(docs, id_col)), T.StructField("y", T.DoubleType()), T.StructField("bag", T.BinaryType())])

    def run(batches):
        for batch in slices(batches, 64):
            x, owner = encode_passages(strings(batch.column(2)))
            bags = [x[owner == k].tobytes() for k in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bags, pa.binary())], names=schema.names)

    rows = bounded(source.join(F.broadcast(picked), "id").select("id", "y", "text")).mapInArrow(run, schema).collect()
    rows.sort(key=lambda r: (r["id"], bytes(r["bag"])))
    bags = [np.frombuffer(r["bag"], np.float32).reshape(-1, SIZE) for r in rows]
    x = np.concatenate(bags) if bags else np.empty((0, SIZE), np.float32)
    owner = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
    return train(x, owner, np.array([1.0 if r["y"] >= 0.5 else 0.0 for r in rows]))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", columns: list[str] | None = None) -> DataFrame:
    """``(id, score)``, or ``columns`` of ``docs`` and ``score``, for each row; no shuffle.

    Null and empty texts have one passage of zeros and get a score like others; null or repeated ids
    give a row each; an empty table gives none. Names of extra columns can't clash.
    """
    names = columns or [id_col]
    fields = [T.StructField(f"c{k}", field_type(docs, c)) for k, c in enumerate(names)]
    schema = T.StructType([*fields, T.StructField("score", T.DoubleType())])

    def run(batches):
        for batch in slices(batches):
            x, owner = encode_passages(strings(batch.column(len(names))))
            y = model.scores(x, owner, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(y.astype(np.float64))], names=schema.names)

    scored = bounded(docs.select(*(col(c).alias(f"c{k}") for k, c in enumerate(names)), col(text_col).alias("text"))).mapInArrow(run, schema)
    taken, name = {c.lower() for c in names}, "score"
    while name in taken:
        name += "_"
    return scored.select(*(F.col(f"c{k}").alias(c) for k, c in enumerate(names)), F.col("score").alias(name))


def keep_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, with their own columns, whose score reaches ``threshold``; equal to it stays.

    Null and empty texts are judged by their score like others; of repeated texts all stay or all go.
    Columns named ``score`` or like those of ``labels`` pass through; an empty table gives no rows.
    Without labels of both classes all scores are alike, and all rows stay or all go.
    """
    scored = score(docs, fit(docs, labels, id_col, text_col), id_col, text_col, docs.columns)
    return scored.where(col(scored.columns[-1]) >= threshold).select(*map(col, docs.columns))
