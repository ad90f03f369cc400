"""Near duplicates by ProbMinHash signatures over word shingles, banding and verification.

A shingle of weight ``w`` is a Poisson process of rate ``w`` whose arrivals fall into registers at
random; a register keeps the shingle that arrived in it first. Two texts agree in a register with
the probability Jaccard similarity of their weights, and by that same similarity, worked out exactly
from the weights, a pair is verified. If each shingle weighs 1, however often a text has it, that is
the Jaccard similarity of the sets. A shingle is followed only until its arrivals come later than
all registers of its text are filled, so most are dropped after one arrival.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import KeyFilter, Scratch, bounded, col, field_type, fresh, hold_only, slices, spread_join, utf8, written
from .byte_pairs import Remembered

SHINGLE, THRESHOLD = 5, 0.8
#: Registers of a signature at most, and the probability with which a pair at the threshold may share
#: no band; from both follow bands and rows, for 0.8 32 bands of 6 registers, which miss 6e-5.
REGISTERS, MISS = 192, 1e-3
#: How often a text has a shingle -> what it weighs there.
WEIGHTS = {"one": np.ones_like, "count": lambda n: n, "log": lambda n: 1 + np.log(n)}
#: Standard errors below the threshold from which on a pair's share of equal registers is too low to verify it.
GATE_ERRORS = 4
#: Texts that a text may be held against, on average, before buckets not yet in one component draw
#: another head for their members instead; and times that they do so at most.
MEETS, HEAD_ROUNDS = 1000, 4
#: Rows of a bucket that a task holds against as many others.
BLOCK = 256
#: Groups of shingles by hash, whose sizes bound what two texts have in common. A power of two up to 256.
GROUPS = 128
#: Texts whose shingles are made at a time.
TEXTS = 512

_STEP = np.uint64(0x9E3779B97F4A7C15)
_ODD = [np.uint64(x) for x in (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0x9FB21C651E98DF25, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def folded(text: Column) -> Column:
    """Lower case, words parted by one space; null counts as empty."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+", " "))


def text_key(norm: Column) -> Column:
    return F.unhex(F.md5(norm))


_word_hash = Remembered(xxhash.xxh3_64_intdigest, 150_000)


def shingles(norm: bytes, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of a folded text, sorted, and how often each is there.

    A text of fewer words has one shingle of all of them; an empty one has none.
    """
    words = norm.split()
    if not words:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    h = np.fromiter(map(_word_hash.__getitem__, words), np.uint64, len(words))
    k = min(width, len(words))
    n = len(words) - k + 1
    total = np.full(n, np.uint64(k), np.uint64)
    for i in range(k):
        total = _mix(total + h[i : i + n] * _ODD[i % 8])
    return np.unique(total, return_counts=True)


def signatures(elements: np.ndarray, weights: np.ndarray, owner: np.ndarray, texts: int, registers: int) -> np.ndarray:
    """``texts x registers`` signatures: for each register, the element that arrives in it first.

    All texts advance together, one arrival of each element still followed a round.
    """
    first = np.full(texts * registers, np.inf)
    who = np.zeros(texts * registers, np.uint64)
    limit = np.full(texts, np.inf)
    state, h, w, d, x = elements.copy(), elements, weights, owner, np.zeros(len(elements))
    while len(h):
        state = _mix(state + _STEP)
        x = x - np.log(((state >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / w
        on = x < limit[d]
        if not on.all():
            state, h, w, d, x = state[on], h[on], w[on], d[on], x[on]
            if not len(h):
                break
        register = (((_mix(state ^ _ODD[0]) >> np.uint64(32)) * np.uint64(registers)) >> np.uint64(32)).astype(np.int64)
        at = d * registers + register
        np.minimum.at(first, at, x)
        won = first[at] == x
        who[at[won]] = h[won]
        live = np.unique(d) if len(d) < texts else np.arange(texts)
        limit[live] = first.reshape(texts, registers)[live].max(axis=1)
    return who.reshape(texts, registers)


def bands_for(threshold: float, registers: int = REGISTERS, miss: float = MISS) -> tuple[int, int]:
    """``(bands, rows)``: as many rows a band as leave the chance of no common band at most ``miss``."""
    if not 0 < threshold <= 1:
        raise ValueError(f"no similarity: {threshold}")
    fit = [(registers // rows, rows) for rows in range(1, registers + 1) if (1 - threshold**rows) ** (registers // rows) <= miss]
    if not fit:
        raise ValueError(f"{registers} registers can't find pairs of similarity {threshold}")
    return min(max(fit, key=lambda x: x[1]), (registers // 12, 12), key=lambda x: x[1])


def probability_jaccard(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    """The probability Jaccard similarity of two sorted sets with weights.

    It is the sum over common ``x`` of ``1 / sum_y max(a_y / a_x, b_y / b_x)``. The larger of the two
    goes by whether ``a_y / b_y`` is at least ``a_x / b_x``, so sums from either end of that order do.
    """
    every = np.union1d(a, b)
    p, q = np.zeros(len(every)), np.zeros(len(every))
    p[np.searchsorted(every, a)], q[np.searchsorted(every, b)] = wa, wb
    with np.errstate(divide="ignore"):
        ratio = p / q
    order = np.argsort(ratio, kind="stable")
    ratio, p, q = ratio[order], p[order], q[order]
    left = np.searchsorted(ratio, ratio, side="left")
    above, below = np.concatenate([np.cumsum(p[::-1])[::-1], [0.0]])[left], np.concatenate([[0.0], np.cumsum(q)])[left]
    both = (p > 0) & (q > 0)
    return float((1 / (above[both] / p[both] + below[both] / q[both])).sum())


def _packed(hashes: np.ndarray, counts: np.ndarray, weights: str) -> bytes:
    """A text's shingles, with how often each is there if that has a weight."""
    return hashes.tobytes() if weights == "one" else hashes.tobytes() + np.minimum(counts, 2**32 - 1).astype(np.uint32).tobytes()


def _unpacked(data: bytes, weights: str) -> tuple[np.ndarray, np.ndarray]:
    n = len(data) // (8 if weights == "one" else 12)
    hashes = np.frombuffer(data, np.uint64, n)
    return hashes, np.ones(n) if weights == "one" else WEIGHTS[weights](np.frombuffer(data, np.uint32, n, 8 * n).astype(np.float64))


def least_agreement(threshold: float, registers: int) -> float:
    """The share of equal registers below which a pair is not verified."""
    return threshold - GATE_ERRORS * (threshold * (1 - threshold) / registers) ** 0.5


def stands_alone(n: int, threshold: float, weights: str = "one") -> bool:
    """Whether a set of ``n`` shingles comes near no other set: its nearest has one more. With
    weights one more may weigh next to nothing, so only a text without shingles stands alone."""
    return n < threshold * (n + 1) - 1e-9 if weights == "one" else n == 0


def features(docs: DataFrame, width: int, threshold: float, bands: int, rows: int, save: Callable[[DataFrame, str], DataFrame] = written, weights: str = "one") -> DataFrame:
    """``(id, key, n, sketch, bands)`` for ``docs (id, text)``: key of the folded text, number of
    distinct shingles, one byte a register, and a hash a band, written to the shared folder."""
    schema = T.StructType(
        [T.StructField("id", field_type(docs, "id")), T.StructField("key", T.BinaryType()), T.StructField("n", T.IntegerType()), T.StructField("sketch", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType()))]
    )
    registers = bands * rows

    def run(batches):
        hold_only("near", _word_hash.clear)
        numbers = np.arange(bands, dtype=np.uint64) * _STEP
        for batch in slices(batches, TEXTS):
            keys = batch.column(1).to_pylist()
            distinct = {k: t for k, t in zip(keys, utf8(batch.column(2)), strict=True)}
            sets = [shingles(t, width) for t in distinct.values()]
            # the one band of a set that comes near no other is the set itself
            large = [k for k, (s, _) in enumerate(sets) if not stands_alone(len(s), threshold, weights)]
            made: dict[int, tuple[bytes, list[int]]] = {}
            if large:
                sizes = np.array([len(sets[k][0]) for k in large])
                sig = signatures(np.concatenate([sets[k][0] for k in large]), WEIGHTS[weights](np.concatenate([sets[k][1] for k in large]).astype(np.float64)), np.repeat(np.arange(len(large)), sizes), len(large), registers)
                mixed = np.broadcast_to(numbers, (len(large), bands)).copy()
                by_band = sig.reshape(len(large), bands, rows)
                for r in range(rows):
                    mixed = _mix(mixed + by_band[:, :, r] * _ODD[r % 8] + _STEP)
                sketches, hashes = (sig & np.uint64(255)).astype(np.uint8), mixed.view(np.int64)
                made = {k: (sketches[j].tobytes(), hashes[j].tolist()) for j, k in enumerate(large)}
            for k, (s, _) in enumerate(sets):
                if k not in made:
                    made[k] = (bytes(registers), [int(np.int64(_mix(s * _ODD[1] + _STEP).sum(dtype=np.uint64).view(np.int64)))] if len(s) else [])
            place = {key: k for k, key in enumerate(distinct)}
            which = [place[k] for k in keys]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([len(sets[k][0]) for k in which], pa.int32()), pa.array([made[k][0] for k in which], pa.binary()), pa.array([made[k][1] for k in which], pa.list_(pa.int64()))],
                names=schema.names,
            )

    norm = folded(F.col("text"))
    keyed = docs.select("id", norm.alias("norm")).select("id", text_key(F.col("norm")).alias("key"), "norm")
    return save(keyed.mapInArrow(run, schema), "features")


def _agree(pairs: DataFrame, least: float) -> DataFrame:
    """The pairs whose sketches agree in a share of at least ``least``."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for k in (2, 3))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array((a == b).mean(axis=1) >= least))

    schema = T.StructType([T.StructField("a", T.BinaryType()), T.StructField("b", T.BinaryType())])
    return pairs.select("a", "b", "sketch_a", "sketch_b").mapInArrow(run, schema)


def _similar(pairs: DataFrame, threshold: float, weights: str = "one") -> DataFrame:
    """``(a, b)`` of those pairs whose shingles have a probability Jaccard similarity of ``threshold`` or more."""

    def run(batches):
        for batch in slices(batches, TEXTS):
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                (a, wa), (b, wb) = _unpacked(x, weights), _unpacked(y, weights)
                if weights != "one":
                    keep.append(probability_jaccard(a, wa, b, wb) >= threshold - 1e-9)
                    continue
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(both >= threshold * (len(a) + len(b) - both) - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    schema = T.StructType([T.StructField("a", T.BinaryType()), T.StructField("b", T.BinaryType())])
    return pairs.select("a", "b", "set_a", "set_b").mapInArrow(run, schema)


class _Near:
    """One run over ``docs (id, text)``; its tables are removed together by ``scratch.drop``."""

    def __init__(self, docs: DataFrame, width: int, threshold: float, bands: int | None, rows: int | None, least: float | None, weights: str = "one"):
        if weights not in WEIGHTS:
            raise ValueError(f"no weights {weights!r}")
        if (bands is None) != (rows is None):
            raise ValueError("give bands and rows, or neither")
        bands, rows = (bands, rows) if bands is not None else bands_for(threshold)
        self.docs, self.width, self.threshold, self.weights = bounded(docs), width, threshold, weights
        self.least = least_agreement(threshold, bands * rows) if least is None else least
        self.scratch = Scratch(docs.sparkSession, "near")
        self.save, self.drop = self.scratch.written, self.scratch.forget
        found = features(docs, width, threshold, bands, rows, self.save, weights)
        # a text's copies are one node from here on
        first = lambda c: F.first(c).alias(c)
        banded_nodes = self.save(found.groupBy("key").agg(F.min("id").alias("id"), F.count("*").alias("copies"), first("n"), first("sketch"), first("bands")), "banded")
        self.found = self.save(found.select("id", "key"), "ids")
        self.drop(found)
        banded = banded_nodes.select("key", F.explode("bands").alias("band"))
        # heads are drawn by a hash in one of two ways, so that a text in many buckets meets few heads, but not always the same one
        draw = F.struct(F.xxhash64("key", F.col("band").bitwiseAND(F.lit(1))).alias("draw"), F.col("key"))
        heads = banded.groupBy("band").agg(F.min(draw).alias("head"), F.max(draw).alias("last")).where("head <> last").select("band", F.col("head.key").alias("head"))
        self.members = self.save(spread_join(banded, heads, "band", F.col("key")), "members")
        self.nodes = self.save(banded_nodes.drop("bands"), "nodes")
        self.drop(banded_nodes)

    def _likely(self, pairs: DataFrame) -> DataFrame:
        """Of a written table ``pairs (a, b)`` of keys, those that size and sketch leave possible; written."""
        node = lambda s: self.nodes.select(F.col("key").alias(s), F.col("n").alias(f"n_{s}"), F.col("sketch").alias(f"sketch_{s}"))
        near = F.least("n_a", "n_b") >= self.threshold * F.greatest("n_a", "n_b") - 1e-9 if self.weights == "one" else F.lit(True)
        sized = spread_join(spread_join(pairs, node("a"), "a", F.col("b")), node("b"), "b", F.col("a"), like=pairs).where(near)
        return self.save(_agree(sized, self.least), "likely")

    def _shingle_sets(self, keys: DataFrame) -> DataFrame:
        """``(key, shingles)`` of the given keys, from the text of one copy of each; written.

        A filter of bounded size leaves the other texts unread where they are; only the sets of
        those that pass are joined with the keys.
        """
        wanted = self.save(keys.distinct().join(self.nodes.select("key", "id"), "key"), "wanted")
        texts = KeyFilter(wanted, F.col("id"), self.save).maybe(self.docs, F.col("id"), "wanted").where("wanted")
        norms = texts.select("id", folded(F.col("text")).alias("norm")).select(text_key(F.col("norm")).alias("key"), "id", "norm")
        schema = T.StructType([T.StructField("key", T.BinaryType()), T.StructField("id", field_type(self.docs, "id")), T.StructField("shingles", T.BinaryType())])
        width, weights = self.width, self.weights

        def run(batches):
            for batch in slices(batches, TEXTS):
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([_packed(*shingles(t, width), weights) for t in utf8(batch.column(2))], pa.binary())], names=schema.names)

        made = norms.select("key", "id", "norm").mapInArrow(run, schema)
        exact = made.join(wanted.select(F.col("key").alias("k"), F.col("id").alias("i")), (F.col("key") == F.col("k")) & F.col("id").eqNullSafe(F.col("i")), "left_semi")
        made = self.save(exact.select("key", "shingles").dropDuplicates(["key"]), "sets")
        self.drop(wanted)
        return made

    def _verified(self, likely: DataFrame, sets: DataFrame) -> DataFrame:
        side = lambda s: sets.select(F.col("key").alias(s), F.col("shingles").alias(f"set_{s}"))
        both = spread_join(spread_join(likely, side("a"), "a", F.col("b")), side("b"), "b", F.col("a"), like=likely)
        return self.save(_similar(both, self.threshold, self.weights), "links")

    def links(self) -> DataFrame:
        """Verified pairs that connect all that are near.

        First each member of a bucket is held against the bucket's head. A bucket whose members are
        then in one component needs no more. In the others, members of different components are
        held against each other, but for pairs that can't reach the threshold: what two texts have
        in common is at most what each has in common with any text of those buckets, counted in
        all or by groups of shingles.
        """
        stars = self.save(self.members.where("key <> head").select(F.col("head").alias("a"), F.col("key").alias("b")).distinct(), "stars")
        likely = self._likely(stars)
        sets = self._shingle_sets(likely.select(F.explode(F.array("a", "b")).alias("key")))
        links = self._verified(likely, sets)
        self.drop(likely, sets)
        roots = components(links, self.save, self.drop)
        placed = self.members.join(roots, self.members["key"] == roots["node"], "left").select("band", "key", F.coalesce("root", "key").alias("root"))
        placed = self.save(placed, "placed")
        self.drop(self.members, roots)
        mixed = placed.groupBy("band").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("band")
        open_ = self.save(spread_join(placed, mixed, "band", F.col("key")), "open")
        self.drop(placed)
        sets = self._shingle_sets(open_.select("key"))
        weighted = self.weights != "one"
        sizes = _shared_sizes(sets, self.weights)
        sizes = self.save(sizes.where(F.col("s") >= self.threshold * F.col("n") - 1e-9), "sizes")
        rows = self.save(open_.join(sizes, "key"), "rows")
        self.drop(open_, sizes)
        for turn in range(HEAD_ROUNDS):
            split = self.save(_split(rows), "split")
            met = split.agg(F.sum(F.col("few").cast("double") * F.col("all"))).first()[0] or 0
            if met <= MEETS * rows.count():
                break
            # other heads join most of what belongs together, before all that is still apart is compared
            heads = rows.groupBy("band").agg(F.min(F.struct(F.xxhash64("key", "band", F.lit(turn)).alias("draw"), "key", "root", "n", "s", "groups")).alias("h"))
            apart = (F.col("root") != F.col("h.root")) & _enough(self.threshold, weighted, *map(F.col, ("n", "s", "groups", "h.n", "h.s", "h.groups")))
            found = spread_join(rows, heads, "band", F.col("key")).where(apart).select(F.col("h.key").alias("a"), F.col("key").alias("b")).distinct()
            again = self.save(found.join(stars, ["a", "b"], "left_anti"), "again")
            older = stars, links, rows, split
            stars = self.save(stars.unionByName(again), "stars")
            likely = self._likely(again)
            verified = self._verified(likely, sets)
            links = self.save(links.unionByName(verified), "links")
            roots = components(links, self.save, self.drop)
            rows = self.save(rows.drop("root").join(roots, F.col("key") == F.col("node"), "left").select("band", "key", "n", "s", "groups", F.coalesce("root", "key").alias("root")), "rows")
            self.drop(*older, again, likely, verified, roots)
            split = self.save(_split(rows), "split")
        across = self.save(_across(rows, split, self.threshold, weighted), "across")
        self.drop(rows, split)
        held = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        apart = self.save(across.join(held, ["a", "b"], "left_anti"), "apart")
        self.drop(across, stars)
        more = self._verified(self._likely(apart), sets)
        self.drop(sets, apart)
        return self.save(links.unionByName(more), "links")


def _split(rows: DataFrame) -> DataFrame:
    """``(band, top, few, all)`` of buckets with several components: the root of the largest, the
    number of texts outside it, and of all texts."""
    counts = rows.groupBy("band", "root").agg(F.count("*").alias("c")).groupBy("band").agg(F.max(F.struct("c", "root")).alias("top"), F.sum("c").alias("all"))
    return counts.where("top.c < all").select("band", F.col("top.root").alias("top"), (F.col("all") - F.col("top.c")).alias("few"), "all")


def _across(rows: DataFrame, split: DataFrame, threshold: float, weighted: bool = False) -> DataFrame:
    """``(a, b)``: pairs of a bucket, in different components, that may reach the threshold.

    Of two such texts one at least is outside the bucket's largest component; only these texts are
    held against the others. Both sides of a bucket are dealt into blocks of about ``BLOCK`` rows, and
    each pair of blocks is a key of its own, so that a large bucket is work for many tasks.
    """
    split = split.select("band", "top", *(F.ceil(F.col(c) / BLOCK).cast("int").alias(c) for c in ("few", "all")))
    dealt = spread_join(rows, split, "band", F.col("key"))
    block = lambda salt, n: F.pmod(F.xxhash64("key", F.lit(salt)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    side = lambda s: [F.col(c).alias(f"{c}_{s}") for c in ("key", "root", "n", "s", "groups")]
    few = dealt.where("root <> top").select("band", block(1, "few").alias("i"), every("all").alias("j"), *side("a"))
    others = dealt.select("band", block(2, "all").alias("j"), every("few").alias("i"), (F.col("root") == F.col("top")).alias("in_top"), *side("b"))
    once = F.col("in_top") | (F.col("key_a") < F.col("key_b"))
    enough = _enough(threshold, weighted, *(F.col(f"{c}_{s}") for s in "ab" for c in ("n", "s", "groups")))
    met = few.join(others, ["band", "i", "j"]).where((F.col("root_a") != F.col("root_b")) & once & enough)
    return met.select(F.least("key_a", "key_b").alias("a"), F.greatest("key_a", "key_b").alias("b")).distinct()


def _enough(threshold: float, weighted: bool, n_a: Column, s_a: Column, groups_a: Column, n_b: Column, s_b: Column, groups_b: Column) -> Column:
    """Whether two sets of sizes ``n`` can be near, if all that they may share is ``s`` of each, and
    of each group of shingles no more than the smaller of their two counts.

    With weights, sizes are shares of a text's whole weight. Registers of two texts hold a shingle
    with these shares as probabilities, so they agree no more often than the shares overlap.
    """
    need = F.lit(threshold - 1e-9) if weighted else threshold / (1 + threshold) * (n_a + n_b) - 1e-9
    common = F.aggregate(F.zip_with(groups_a, groups_b, lambda x, y: F.least(x, y)), F.lit(0.0 if weighted else 0), lambda total, x: total + x)
    return (F.least(s_a, s_b) >= need) & (common >= need)


def _shared_sizes(sets: DataFrame, weights: str = "one") -> DataFrame:
    """``(key, n, s, groups)`` of ``sets (key, shingles)``: the number of shingles, that of those
    which other texts have too, and these counted by group. A shingle that only one text has is
    common to no pair. With weights these are shares of the text's whole weight, not numbers.
    """
    bytes_of = 8 if weights == "one" else 12
    each = sets.select("key", F.explode(_longs(F.col("shingles"), bytes_of)).alias("shingle"))
    single = each.groupBy("shingle").agg(F.count("*").alias("n"), F.min("key").alias("key")).where("n = 1")
    alone = single.groupBy("key").agg(F.collect_list("shingle" if weights != "one" else F.substring("shingle", 1, 1)).alias("alone"))
    kind, number = (T.IntegerType(), pa.int32()) if weights == "one" else (T.DoubleType(), pa.float64())
    schema = T.StructType([T.StructField("key", T.BinaryType()), T.StructField("n", kind), T.StructField("s", kind), T.StructField("groups", T.ArrayType(kind))])

    def counted(whole: bytes, lone: list[bytes]) -> tuple[int, np.ndarray]:
        count = lambda low: np.bincount(low & (GROUPS - 1), minlength=GROUPS).astype(np.int32)
        return len(whole) // 8, count(np.frombuffer(whole, np.uint8)[::8]) - count(np.frombuffer(b"".join(lone), np.uint8))

    def weighed(whole: bytes, lone: list[bytes]) -> tuple[float, np.ndarray]:
        hashes, w = _unpacked(whole, weights)
        shared = ~np.isin(hashes, np.frombuffer(b"".join(lone), np.uint64))
        return 1.0, np.bincount((hashes & np.uint64(GROUPS - 1)).astype(np.int64), weights=np.where(shared, w / w.sum(), 0.0), minlength=GROUPS)

    size = counted if weights == "one" else weighed

    def run(batches):
        for batch in slices(batches, TEXTS):
            told = [size(whole, lone or []) for whole, lone in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            groups = [g for _, g in told]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _ in told], number), pa.array([g.sum().item() for g in groups], number), pa.array(groups, pa.list_(number))], names=schema.names)

    return sets.join(alone, "key", "left").select("key", "shingles", "alone").mapInArrow(run, schema)


def _longs(data: Column, each: int = 8) -> Column:
    """The shingles of a packed set, as they are, if each takes ``each`` bytes with its count."""
    return F.transform(F.sequence(F.lit(0), F.expr(f"octet_length(shingles) div {each}") - 1), lambda i: F.substring(data, i * 8 + 1, F.lit(8)))


def components(links: DataFrame, save: Callable[[DataFrame, str], DataFrame] = written, drop: Callable[..., None] = lambda *_: None) -> DataFrame:
    """``(node, root)``: of each node in ``links (a, b)``, the smallest node of its component.

    Large-star and small-star steps in turn: each links the neighbours of a node to the smallest of
    them, until nothing changes. Each round's edges are written, so lost executors cost one round;
    nodes with very many neighbours are dealt over tasks.
    """
    edges = save(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = save(spread_join(both, low, "u", F.col("v")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = spread_join(large, low, "u", F.col("v")).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        before, edges = edges, save(small.where("u <> v").distinct(), "edges")
        drop(before, large)
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        state = now


def _run(docs: DataFrame, id_col: str, text_col: str, width: int, threshold: float, bands: int | None, rows: int | None, least: float | None, weights: str) -> tuple[_Near, DataFrame]:
    """The run, and ``(key, root, class_id, class_size, best)`` of each text: ``best`` if the row that
    stays is one of its copies."""
    near = _Near(docs.select(col(id_col).alias("id"), col(text_col).alias("text")), width, threshold, bands, rows, least, weights)
    roots = components(near.links(), near.save, near.drop)
    placed = near.save(near.nodes.join(roots, near.nodes["key"] == roots["node"], "left").select("key", "id", "copies", F.coalesce("root", "key").alias("root")), "placed")
    # the smallest id, nulls last, and of texts that share it the smallest key
    first = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("key").alias("key"))
    classes = placed.groupBy("root").agg(F.min(first).alias("first"), F.sum("copies").alias("class_size"))
    joined = spread_join(placed, classes, "root", F.col("key"))
    return near, joined.select("key", "root", F.col("first.id").alias("class_id"), "class_size", (F.col("key") == F.col("first.key")).alias("best"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE, threshold: float = THRESHOLD, bands: int | None = None, rows: int | None = None, least: float | None = None, weights: str = "one") -> DataFrame:
    """``(id, class_id, class_size, kept, class_key)``, a row for each row of ``docs``.

    Texts are linked if the probability Jaccard similarity of their ``width``-word shingles is at least
    ``threshold``. ``weights`` says what a shingle weighs in a text that has it ``n`` times: ``one``
    weighs each 1, so that it is the Jaccard similarity of the sets; ``count`` ``n``, ``log``
    ``1 + ln n``. Classes are the connected components, named by their smallest id, whose row is
    ``kept``. Texts alike in lower case and white space aside are copies. Null and empty texts are
    copies of each other; texts of fewer words than ``width`` have one shingle. Null ids come last;
    of repeated rows with a class's smallest id all are ``kept``. Classes of different texts with the
    same smallest id share their ``class_id``; ``class_key`` tells them apart. Other columns are
    ignored, so their names can't clash; an empty table gives no rows.

    A pair of similarity ``s`` shares no band with probability ``(1 - s ** rows) ** bands``. Both follow
    from ``threshold``, so that it is ``MISS`` at most for a pair that just reaches it, unless they
    are given. ``least``, the share of equal registers from which on a pair is verified, follows from
    ``threshold`` too if not given.
    """
    near, placed = _run(docs, id_col, text_col, width, threshold, bands, rows, least, weights)
    told = spread_join(near.found.select("id", "key"), placed, "key", F.col("id"))
    out = written(told.select(F.col("id").alias(id_col), "class_id", "class_size", F.col("id").eqNullSafe(F.col("class_id")).alias("kept"), F.lower(F.hex("root")).alias("class_key")), "near-classes")
    near.scratch.drop()
    return out


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE, threshold: float = THRESHOLD, bands: int | None = None, rows: int | None = None, least: float | None = None, weights: str = "one") -> DataFrame:
    """One row of each class of ``near_duplicates``, with its own columns: that with the smallest id.

    Null ids come last, and of repeated rows with that id one stays; null and empty texts are one
    class. Classes that share their smallest id keep a row each. Extra columns, whatever their names,
    go through; an empty table stays one.
    """
    near, placed = _run(docs, id_col, text_col, width, threshold, bands, rows, least, weights)
    counts = near.save(near.found.groupBy("id", "key").agg(F.count("*").alias("times")), "counts")
    told = spread_join(counts, placed, "key", F.col("id"))
    stays = F.col("best") & F.col("id").eqNullSafe(F.col("class_id"))
    odd = written(told.select("id", "key", "times", stays.alias("stays")).where("NOT stays OR times > 1"), "near-odd")
    near.scratch.drop()
    return _keep_rows(docs, id_col, text_col, odd)


def _keep_rows(docs: DataFrame, id_col: str, text_col: str, odd: DataFrame) -> DataFrame:
    """The rows that stay: all but those of ``odd`` that are told to go, and one of repeated ones.

    Only rows that a filter of bounded size takes for such rows are shuffled.
    """
    key, flag = fresh(docs, "sf_key", "sf_flag")
    rows = docs.withColumn(key, text_key(folded(col(text_col))))
    pair = lambda i, k: F.struct(i.alias("i"), k.alias("k"))
    rows = KeyFilter(odd, pair(F.col("id"), F.col("key"))).maybe(rows, pair(col(id_col), col(key)), flag)
    own = list(map(col, docs.columns))
    marks = odd.select(F.col("id").alias("sf_odd_id"), F.col("key").alias("sf_odd_key"), F.col("stays").alias("sf_odd_stays"))
    names = dict(zip(marks.columns, fresh(rows, *marks.columns), strict=True))
    marks = marks.select(*(F.col(a).alias(b) for a, b in names.items()))
    mid, mkey, mstays = (col(b) for b in names.values())
    maybe = rows.where(col(flag)).join(marks, (col(key) == mkey) & col(id_col).eqNullSafe(mid), "left")
    plain = maybe.where(mkey.isNull()).select(*own)
    repeated = maybe.where(mstays).dropDuplicates([key]).select(*own)
    return rows.where(~col(flag)).select(*own).unionByName(plain).unionByName(repeated)
