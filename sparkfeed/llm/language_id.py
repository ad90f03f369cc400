"""Language identification in two steps: the family first, then the language within it.

A text is a vector of counts of letter sequences. A linear model with probabilities tells language
families apart; within a family, a linear support vector machine for each pair of languages votes.
The models are learnt on the driver from a sample of bounded size; texts are measured and told apart
where they are.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import bounded, col, field_type, slices, strings
from .quality_mil import held_out

#: Texts of the training sample at most, over all languages.
SAMPLE_TEXTS = 2000
BUCKETS = 8192
#: Letters of a sequence at most; a space stands for what is between words.
LONGEST = 4
#: Code points that are measured at a time, however long the text.
STEP = 1 << 20
#: What a text gets that has no letter, or if no language was learnt.
UNKNOWN = "und"
#: Languages of a family, by their ISO 639-1 codes. Another code is a family of its own.
FAMILIES = {
    "germanic": "en de nl af fy lb yi sv da no nb nn is fo",
    "romance": "fr es it pt ca gl oc ro la",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "baltic": "lt lv",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz ky tk tt",
    "iranian": "fa ku ps tg",
    "indic": "hi ur bn mr gu pa ne si",
    "dravidian": "ta te kn ml",
    "semitic": "ar he mt am",
    "malay": "id ms jv su tl",
    "celtic": "ga gd cy br",
    "chinese": "zh",
    "japanese": "ja",
    "korean": "ko",
    "greek": "el",
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}


def family_of(lang: str) -> str:
    """The family of a language code, whatever its region or script; an unknown code is its own."""
    return _FAMILY.get(lang.replace("_", "-").split("-")[0].lower(), f"={lang}")


@cache
def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def measure(text: str) -> np.ndarray:
    """The text's vector: roots of its counts of letter sequences, of length 1; zeros without letters."""
    counts = np.zeros(BUCKETS)
    tail = np.array([32], np.uint32)
    for at in range(0, len(text), STEP):
        codes = np.frombuffer(text[at : at + STEP].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = np.where(_letters()[codes], codes, np.uint32(32))
        last = np.concatenate([tail[-1:], codes[:-1]])
        codes = np.concatenate([tail, codes[(codes != 32) | (last != 32)]])
        _count(codes, len(tail), counts)
        tail = codes[-(LONGEST - 1) :]
    if tail[-1] != 32:
        _count(np.append(tail, np.uint32(32)), len(tail), counts)
    root = np.sqrt(counts)
    size = np.sqrt(counts.sum())
    return (root / size if size else root).astype(np.float32)


def _count(codes: np.ndarray, known: int, counts: np.ndarray) -> None:
    """Adds the sequences that end behind the first ``known`` codes."""
    wide, mixed = codes.astype(np.uint64), np.zeros(len(codes), np.uint64)
    for length in range(1, LONGEST + 1):
        if len(codes) < length:
            return
        mixed = mixed[: len(codes) - length + 1] * np.uint64(0x9E3779B97F4A7C15) + wide[length - 1 :] + np.uint64(length)
        ends = mixed[max(0, known - length + 1) :]
        counts += np.bincount(((ends * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(51)).astype(np.int64), minlength=BUCKETS)


@dataclass
class Model:
    """Weights by family, and of each pair of languages of a family; the last row of each is a bias."""

    families: list[str]
    langs: dict[str, list[str]]
    family_w: np.ndarray
    pairs: list[tuple[str, str]]
    pair_w: np.ndarray

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Language and score of each row of ``x``."""
        if not self.families:
            return [UNKNOWN] * len(x), np.zeros(len(x))
        x = np.hstack([x, np.ones((len(x), 1), np.float32)])
        share, margin = _softmax(x @ self.family_w), x @ self.pair_w
        sure = 1 / (1 + np.exp(-np.clip(2 * margin, -30, 30)))
        column = {pair: k for k, pair in enumerate(self.pairs)}
        names, scores = np.empty(len(x), object), np.empty(len(x))
        best = share.argmax(axis=1)
        for f, family in enumerate(self.families):
            rows, langs = np.flatnonzero(best == f), self.langs[family]
            votes, belief = np.zeros((len(rows), len(langs))), np.zeros((len(rows), len(langs)))
            for a, b in combinations(range(len(langs)), 2):
                k = column[langs[a], langs[b]]
                won, p = margin[rows, k] >= 0, sure[rows, k]
                votes[:, a] += won
                votes[:, b] += ~won
                belief[:, a] += p
                belief[:, b] += 1 - p
            others = max(1, len(langs) - 1)
            pick = (votes + belief / (others + 1)).argmax(axis=1)  # ties of votes go to the surer one
            names[rows] = np.array(langs, object)[pick]
            within = belief[np.arange(len(rows)), pick] / others if len(langs) > 1 else 1.0
            scores[rows] = share[rows, f] * within
        return names.tolist(), np.clip(scores, 0, 1)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _family_weights(x: np.ndarray, y: np.ndarray, kinds: int, decay: float = 1e-5, steps: int = 150, rate: float = 12.0) -> np.ndarray:
    """Multinomial logistic regression by accelerated gradient steps; each class weighs the same."""
    w = np.zeros((x.shape[1], kinds), np.float32)
    if kinds == 1:
        return w
    each = ((1 / np.bincount(y, minlength=kinds))[y, None] / kinds).astype(np.float32)
    ahead = w.copy()
    for step in range(steps):
        p = _softmax(x @ ahead)
        p[np.arange(len(y)), y] -= 1
        after = ahead - rate * (x.T @ (p * each) + decay * ahead)
        ahead = after + step / (step + 3) * (after - w)
        w = after
    return w


def _svm(x: np.ndarray, y: np.ndarray, cost: float = 10.0, rounds: int = 60, seed: int = 5) -> np.ndarray:
    """Weights of a linear support vector machine with squared hinge loss, by dual coordinate descent.

    ``y`` is 1 or -1; each class weighs the same.
    """
    rng, n = np.random.default_rng(seed), len(y)
    y = y.astype(np.float32)
    bound = np.where(y > 0, n / (2 * max(1, (y > 0).sum())), n / (2 * max(1, (y < 0).sum()))) * cost
    gram = (x @ x.T) * np.outer(y, y)
    diagonal = 0.5 / bound
    alpha, slope = np.zeros(n), np.full(n, -1.0)  # slope: the gradient without its diagonal part
    for _ in range(rounds):
        most = 0.0
        for k in rng.permutation(n):
            now = slope[k] + diagonal[k] * alpha[k]
            step = max(-alpha[k], -now / (gram[k, k] + diagonal[k]))
            if abs(step) > 1e-9:
                alpha[k] += step
                slope += step * gram[k]
                most = max(most, abs(step))
        if most < 1e-4:
            break
    return x.T @ (alpha * y)


def train(x: np.ndarray, langs: list[str]) -> Model:
    """The models from vectors and their languages; one language alone is always the answer."""
    known = sorted(set(langs))
    by_family: dict[str, list[str]] = {}
    for lang in known:
        by_family.setdefault(family_of(lang), []).append(lang)
    families = sorted(by_family)
    x = np.hstack([x, np.ones((len(x), 1), np.float32)]).astype(np.float32)
    name, size = np.array(langs, object), BUCKETS + 1
    family_y = np.array([families.index(family_of(lang)) for lang in langs], np.int64)
    pairs = [pair for family in families for pair in combinations(by_family[family], 2)]
    weights = [_svm(x[some], np.where(name[some] == a, 1.0, -1.0)) for a, b in pairs for some in [np.flatnonzero((name == a) | (name == b))]]
    family_w = _family_weights(x, family_y, len(families)) if families else np.zeros((size, 0))
    return Model(families, by_family, family_w.astype(np.float32), pairs, np.array(weights, np.float32).reshape(len(pairs), size).T)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_texts: int = SAMPLE_TEXTS) -> Model:
    """The model, learnt from texts with a language and a letter that are not held out.

    Each language gives about as many texts, ``sample_texts`` over all of them at most, the first in
    the order of a hash of id and text: a bound on the hash, from counts by language, picks a few
    more than needed, so only those are sorted. The sample is thus the same at each run and its
    size the same at each scale. Repeated rows all count; null ids are like others.
    """
    source = docs.select(col(id_col).alias("id"), col(text_col).alias("text"), col(lang_col).cast("string").alias("lang"))
    source = source.where(col("lang").isNotNull() & F.coalesce(col("text"), F.lit("")).rlike(r"\p{L}") & ~held_out(F.col("id")))
    counted = source.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(sample_texts)
    counts = {r["lang"]: r["n"] for r in counted.collect()}
    if len(counts) < 2:
        warnings.warn("texts of fewer than two languages to learn from: all predictions will be alike", stacklevel=2)
    if not counts:
        return train(np.empty((0, BUCKETS), np.float32), [])
    each = max(1, sample_texts // len(counts))
    share = docs.sparkSession.createDataFrame([(lang, min(1.0, (each + 4 * each**0.5 + 4) / n)) for lang, n in counts.items()], "lang string, share double")
    place = F.pmod(F.xxhash64(F.lit("lang"), F.coalesce(F.col("id").cast("string"), F.lit("")), "text"), F.lit(1 << 40)) / float(1 << 40)
    near = source.withColumn("place", place).join(F.broadcast(share), "lang").where("place <= share")
    picked = near.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy("place", "id", "text"))).where(F.col("rank") <= each).select("lang", "text")
    schema = "lang string, at binary, value binary"

    def run(batches):
        for batch in slices(batches, 64):
            x = [measure(t) for t in strings(batch.column(1))]
            at = [np.flatnonzero(v).astype(np.uint16) for v in x]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([a.tobytes() for a in at], pa.binary()), pa.array([v[a].tobytes() for v, a in zip(x, at, strict=True)], pa.binary())], names=["lang", "at", "value"])

    rows = bounded(picked).mapInArrow(run, schema).collect()
    rows.sort(key=lambda r: (r["lang"], bytes(r["at"]), bytes(r["value"])))
    x = np.zeros((len(rows), BUCKETS), np.float32)
    for k, r in enumerate(rows):
        x[k, np.frombuffer(r["at"], np.uint16)] = np.frombuffer(r["value"], np.float32)
    return train(x, [r["lang"] for r in rows])


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, lang_pred, score)`` for each row of ``docs``; no shuffle.

    A text that is null or has no letter is ``und`` with score 0. The score is the family's
    probability times how surely the language wins against each other of its family. Null or
    repeated ids give a row each; other columns are ignored, so their names can't clash; an empty
    table gives no rows. Whole texts are measured, however long.
    """
    schema = T.StructType([T.StructField("id", field_type(docs, id_col)), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches):
        for batch in slices(batches, 128):
            x = np.array([measure(t) for t in strings(batch.column(1))])
            names, scores = model.predict(x)
            none = ~np.array(batch.column(2).fill_null(False).to_pylist(), bool)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([UNKNOWN if bare else n for n, bare in zip(names, none, strict=True)], pa.string()), pa.array(np.where(none, 0.0, scores))], names=schema.names
            )

    some = F.coalesce(col(text_col).rlike(r"\p{L}"), F.lit(False))
    return bounded(docs.select(col(id_col).alias("id"), col(text_col).alias("text"), some.alias("some"))).mapInArrow(run, schema).withColumnRenamed("id", id_col)
