"""Licence scan: ordered signature rules, gated by keywords, with overlapping detections resolved."""

from __future__ import annotations

from bisect import bisect_left
from functools import cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import bounded, col, field_type, slices, utf8
from .license_rules import BASE_PHRASES, KINDS, SIGNATURES, base_rules, compile_rules

#: Priority of rules that merely point to a licence.
HINT = KINDS["hint"][0]
#: Bytes that are no part of a word become a space; A-Z become lower case.
_FOLD = bytes(32 if b < 0x30 or 0x3A <= b < 0x41 or 0x5B <= b < 0x61 or 0x7B <= b < 0x80 else b + 32 if 0x41 <= b < 0x5B else b for b in range(256))

DETECTION = T.StructType(
    [
        T.StructField("label", T.StringType()),
        T.StructField("rule", T.StringType()),
        T.StructField("first_word", T.LongType()),
        T.StructField("end_word", T.LongType()),
        T.StructField("priority", T.IntegerType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("kept", T.BooleanType()),
    ]
)


@cache
def _rules(signatures: str, phrases: tuple):
    """The rules, and each keyword's rules: a rule is looked at if its rarest-looking keyword, or one of its other forms, is there."""
    rules = base_rules(dict(phrases)) + compile_rules(signatures)
    by_keyword: dict[bytes, list[int]] = {}
    for k, rule in enumerate(rules):
        for word in max(rule.keywords, key=lambda ws: (min(map(len, ws)), sorted(ws))):
            by_keyword.setdefault(word, []).append(k)
    return rules, by_keyword, frozenset(by_keyword)


def resolve(found: list[tuple]) -> list[dict]:
    """Detections ``(first, end, order, rule)``, with those marked that overlaps leave standing.

    A detection whose interval lies within that of another gives way to it, but no licence to a mere
    hint; of equal intervals the better priority stands, then the table's order. What is left stands,
    in order of priority, then length, then place, unless it overlaps one of a better priority.
    """
    within = sorted(range(len(found)), key=lambda k: (found[k][0], -found[k][1], found[k][3].priority, found[k][2]))
    reach = {True: -1, False: -1}  # how far earlier detections go: hints too, and licences alone
    outer = []
    for k in within:
        _, end, _, rule = found[k]
        hint = rule.priority == HINT
        if end > reach[hint]:
            outer.append(k)
        reach[True] = max(reach[True], end)
        if not hint:
            reach[False] = max(reach[False], end)
    # those that stand don't contain each other, so their ends are in the order of their starts
    standing, stands = [], set()
    for k in sorted(outer, key=lambda k: (found[k][3].priority, found[k][0] - found[k][1], found[k][0], found[k][2])):
        first, end, _, rule = found[k]
        at = bisect_left(standing, (first,))
        near = []
        i = at - 1
        while i >= 0 and standing[i][1] > first:
            near.append(standing[i])
            i -= 1
        i = at
        while i < len(standing) and standing[i][0] < end:
            near.append(standing[i])
            i += 1
        if not any(p < rule.priority for _, _, p in near):
            standing.insert(at, (first, end, rule.priority))
            stands.add(k)
    out = [{"label": r.label, "rule": r.name, "first_word": a, "end_word": b, "priority": r.priority, "confidence": r.confidence, "kept": k in stands} for k, (a, b, _, r) in enumerate(found)]
    return sorted(out, key=lambda d: (d["first_word"], d["end_word"], d["rule"]))


def scan(text: bytes, rules, by_keyword, keywords) -> tuple[int, list[dict]]:
    """The number of words in a text, and its detections."""
    words = text.translate(_FOLD).split()
    there = keywords.intersection(words)
    if not there:
        return len(words), []
    vocabulary = set(words)
    joined, starts, found = b" " + b" ".join(words) + b" ", None, []
    for k in sorted({k for w in there for k in by_keyword[w]}):
        rule = rules[k]
        if any(map(vocabulary.isdisjoint, rule.keywords)) or any(map(vocabulary.isdisjoint, rule.context)):
            continue
        for m in rule.pattern.finditer(joined):
            if starts is None:
                starts = list(accumulate((len(w) + 1 for w in words), initial=1))
            found.append((bisect_left(starts, m.start()), bisect_left(starts, m.end() + 1), k, rule))
    base = [d for d in found if d[3].priority == 0]
    plain = [{"label": r.label, "rule": r.name, "first_word": a, "end_word": b, "priority": 0, "confidence": r.confidence, "kept": True} for a, b, _, r in base]
    return len(words), plain + resolve([d for d in found if d[3].priority > 0])


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", signatures: str = SIGNATURES, phrases: dict[str, str] = BASE_PHRASES) -> DataFrame:
    """``(id, n_words, detections)``: what the rules find in each whole text, in word positions.

    ``detections`` is an array of structs; those with ``kept`` false gave way to others. ``phrases``
    are rules of their own, named ``base/...``; all their places are among the detections, and they
    neither give way nor make others do so. Null and empty texts have no words and no detections;
    null or repeated ids give a row each; other columns are ignored, so their names can't clash; an
    empty table gives no rows. Whole texts are scanned, however long. No shuffle.
    """
    schema = T.StructType([T.StructField("id", field_type(docs, id_col)), T.StructField("n_words", T.LongType()), T.StructField("detections", T.ArrayType(DETECTION))])
    fixed = tuple(phrases.items())
    arrow = pa.list_(pa.struct([("label", pa.string()), ("rule", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("priority", pa.int32()), ("confidence", pa.float64()), ("kept", pa.bool_())]))

    def run(batches):
        parts = _rules(signatures, fixed)
        for batch in slices(batches):
            found = [scan(t, *parts) for t in utf8(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _ in found], pa.int64()), pa.array([d for _, d in found], arrow)], names=["id", "n_words", "detections"])

    return bounded(docs.select(col(id_col).alias("id"), col(text_col).alias("text"))).mapInArrow(run, schema).select(F.col("id").alias(id_col), "n_words", "detections")


def summary(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per text: counts and places of the base phrases, labels, and a score from 0 to 1.

    The score is the chance that at least one standing detection is right, their confidences taken
    as independent. Labels are those of standing detections and of all base phrases.
    """
    base = F.filter("detections", lambda d: d["priority"] == 0)
    kept = F.filter("detections", lambda d: d["kept"])
    joined = lambda xs: F.array_join(F.array_sort(F.array_distinct(xs)), ",")
    names = lambda xs: F.transform(xs, lambda d: d["label"])
    starts = F.transform(base, lambda d: d["first_word"])
    return scanned.select(
        col(id_col),
        "n_words",
        F.size(base).cast("bigint").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        joined(names(base)).alias("base_labels"),
        joined(F.concat(names(base), names(kept))).alias("labels"),
        (1 - F.aggregate(kept, F.lit(1.0), lambda a, d: a * (1 - d["confidence"]))).alias("score"),
    )
