"""Spelling variants: words that differ by one code point, by bit-sliced indexes of the vocabulary.

The vocabulary is cut into blocks of words that can be near each other. In a block, each position and
letter has a bitset of the words with that letter there. A query walks its letters once; sets of words
without an error, and with one replaced, inserted or deleted letter, are kept as bits and advance
together, 64 words an operation.
"""

from __future__ import annotations

import string

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import Scratch, col, written

#: Words of a block, about and at most; of hot keys, slices of at most so many make blocks of two.
BLOCK, SLICE = 512, 2048
#: Code points of a slice at most, for very long words.
SLICE_LETTERS = 1 << 22
#: Up to this length, words of several keys share a block.
SHORT = 64
RUN = r"[A-Za-zÀ-ÿ]+"


def word_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slip_every: int = 97, shortest: int = 5) -> DataFrame:
    """``word`` for each run of letters of each text, A-Z lower-cased, with planted slips.

    A run whose hash with its text's id is divisible by ``slip_every`` loses one letter, so that the
    variants to find are known; 0 plants none. Results of under ``shortest`` letters are left out.
    Null text has no runs, a null id counts as empty.
    """
    run = F.explode(F.regexp_extract_all(F.coalesce(col(text_col), F.lit("")), F.lit(RUN), F.lit(0)))
    runs = docs.select(F.coalesce(col(id_col).cast("string"), F.lit("")).alias("id"), run.alias("run")).where(F.length("run") >= shortest)
    # of words of ASCII alone, Spark's own lower case is the same, and much faster
    plain = F.octet_length("run") == F.length("run")
    runs = runs.select("id", F.when(plain, F.lower("run")).otherwise(F.translate("run", string.ascii_uppercase, string.ascii_lowercase)).alias("word"))
    if slip_every:
        runs = runs.select("word", F.crc32(F.concat("id", F.lit(":"), "word")).alias("h"))
        at = (F.col("h") % F.length("word")).cast("int")
        slip = F.concat(F.substring(F.col("word"), F.lit(1), at), F.substring(F.col("word"), at + 2, F.length("word")))
        runs = runs.select(F.when(F.col("h") % slip_every == 0, slip).otherwise(F.col("word")).alias("word"))
    return runs.select("word").where(F.length("word") >= shortest)


def vocabulary(words: DataFrame, word_col: str = "word", least: int = 3) -> DataFrame:
    """``(word, n)``: the distinct words with at least ``least`` occurrences; null is none."""
    return words.select(col(word_col).alias("word")).where(F.col("word").isNotNull()).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def near_pairs(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Places ``(i, k)`` of all words that differ by exactly one inserted, deleted or replaced code point, both ways."""
    count = len(words)
    lens = np.array([len(w) for w in words])
    order = np.argsort(-lens, kind="stable")  # as queries end, those that go on are the first
    longest, span = int(lens.max(initial=0)), -(-count // 64)
    table = np.array([words[k] for k in order], f"<U{max(1, longest)}").view(np.uint32).reshape(count, -1)
    lens = lens[order]
    letters = np.unique(table)
    code = np.searchsorted(letters, table)
    kinds = np.arange(len(letters))[:, None]

    def packed(flags: np.ndarray) -> np.ndarray:
        bits = np.packbits(flags, axis=-1, bitorder="little")
        return np.ascontiguousarray(np.pad(bits, [*[(0, 0)] * (bits.ndim - 1), (0, span * 8 - bits.shape[-1])])).view(np.uint64)

    none = np.zeros((len(letters), span), np.uint64)
    slices = lambda p: packed((code[:, p] == kinds) & (lens > p)) if p < longest else none
    of_length = {n: packed(lens == n) for n in np.unique(np.concatenate([lens - 1, lens, lens + 1]))}
    found = np.zeros((count, span), np.uint64)
    exact = np.full((count, span), ~np.uint64(0))
    replaced, longer, shorter = (np.zeros((count, span), np.uint64) for _ in range(3))
    before, here, after = none, slices(0), slices(1)
    end = np.searchsorted(-lens, 0)  # words of no letters
    found[end:] = exact[end:] & of_length.get(1, np.uint64(0))
    for p in range(longest):
        going = int(np.searchsorted(-lens, -p))  # queries with a letter at p
        letter = code[:going, p]
        same, was = here[letter], exact[:going].copy()
        longer[:going] = (longer[:going] | was) & after[letter]
        shorter[:going] = (shorter[:going] & before[letter]) | was
        replaced[:going] = (replaced[:going] & same) | (was & ~same)
        exact[:going] = was & same
        done = int(np.searchsorted(-lens, -(p + 1)))
        if done < going:
            k, m = slice(done, going), p + 1
            found[k] = (replaced[k] & of_length[m]) | ((longer[k] | exact[k]) & of_length[m + 1]) | (shorter[k] & of_length[m - 1])
        before, here, after = here, after, slices(p + 2)
    q, at = np.nonzero(found)
    bits = np.unpackbits(found[q, at].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    row, bit = np.nonzero(bits)
    return order[q[row]], order[at[row] * 64 + bit]


def _block(block: pa.Table) -> pa.Table:
    """What a block's words have near them there: how many, and the most frequent of them.

    A pair is counted under one key alone: that of the shorter word's length, by the first half if it
    agrees, else by the last half.
    """
    words, sides, shorts, halves = (block.column(c).to_pylist() for c in ("word", "side", "short", "half"))
    n, part = block.column("n").to_numpy(), block.column("part").to_numpy()
    same_part = block.column("low")[0].as_py() == block.column("high")[0].as_py()
    i, k = near_pairs(words)
    ids: dict = {}
    number = lambda x: ids.setdefault(x, len(ids))
    key = np.array([number((s, a, h)) for s, a, h in zip(sides, shorts, halves, strict=True)])
    start = np.array([number((w[: a // 2],)) for w, a in zip(words, shorts, strict=True)])
    lens, short, last = np.array([len(w) for w in words]), np.array(shorts), np.array([s == "S" for s in sides])
    good = (key[i] == key[k]) & (np.minimum(lens[i], lens[k]) == short[i]) & ~(last[i] & (start[i] == start[k])) & (same_part | (part[i] != part[k]))
    i, k = i[good], k[good]
    place = np.empty(len(words), np.int64)
    place[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    by = np.lexsort((place[k], -n[k], i))
    i, k = i[by], k[by]
    first = np.flatnonzero(np.diff(i, prepend=-1))
    counts = np.diff(np.append(first, len(i)))
    own, best = i[first], k[first]
    text = block.column("word").combine_chunks()
    return pa.table({"word": text.take(pa.array(own)), "n_near": pa.array(counts, pa.int64()), "best": text.take(pa.array(best)), "best_n": pa.array(n[best], pa.int64())})


def _near(vocab: DataFrame, run: Scratch) -> DataFrame:
    """``(word, n_near, best, best_n)`` of the words that have others near them.

    Two words that differ by one code point share the first or the last half of the shorter one's
    length. So these halves are keys, and words with a key in common make up blocks. A key with more
    than ``SLICE`` words is dealt into slices, and each pair of slices is a block of its own.
    """
    long = F.length("word")
    keys = []
    for short in (long, long - 1):
        half = F.floor(short / 2).cast("int")
        for side, text in (("P", F.substring(F.col("word"), F.lit(1), half)), ("S", F.substring(F.col("word"), long - half + 1, half))):
            keys.append(F.struct(F.lit(side).alias("side"), short.alias("short"), text.alias("half")))
    placed = vocab.select("word", "n", F.explode(F.array(*keys)).alias("k")).select("word", "n", "k.*").where("short >= 0")
    placed = placed.withColumn("key", F.xxhash64("side", "short", "half"))
    most = F.greatest(F.lit(2), F.least(F.lit(SLICE), (F.lit(SLICE_LETTERS) / (F.col("short") + 1)).cast("int")))
    hot = placed.groupBy("key", "short").agg(F.count("*").alias("rows")).where(F.col("rows") > most).groupBy("key").agg(F.max(F.ceil(F.col("rows") / most)).cast("int").alias("parts"))
    hot = run.written(hot, "hot")
    blocks = max(1, 4 * vocab.count() // BLOCK)
    mixed = F.when(F.col("short") <= SHORT, F.pmod(F.col("key"), F.lit(blocks))).otherwise(F.col("key"))
    plain = lambda df: df.select("word", "n", "side", "short", "half", F.lit(False).alias("hot"), mixed.alias("block"), F.lit(0).alias("part"), F.lit(0).alias("low"), F.lit(0).alias("high"))
    if hot.isEmpty():
        rows = plain(placed)
    else:
        dealt = placed.join(hot, "key").withColumn("part", F.pmod(F.xxhash64(F.lit("part"), "word"), F.col("parts")).cast("int"))
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        dealt = dealt.select("word", "n", "side", "short", "half", F.lit(True).alias("hot"), F.col("key").alias("block"), "part", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"))
        rows = plain(placed.join(hot, "key", "left_anti")).unionByName(dealt)
    found = rows.groupBy("hot", "block", "low", "high").applyInArrow(lambda block: _block(block), "word string, n_near bigint, best string, best_n bigint")
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word"))).alias("best")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", F.col("best.word").alias("best"), (-F.col("best.n")).alias("best_n"))


def _roots(links: DataFrame, run: Scratch) -> DataFrame:
    """``(word, root)`` for rows ``(word, form)``: each round doubles how far a word's pointer reaches.

    A form is at least twice as frequent, so no chain is longer than the binary logarithm of the
    largest count, and the rounds are the logarithm of that.
    """
    now = run.written(links.select("word", F.col("form").alias("root")), "links")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        now = run.written(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if now.where("moved").isEmpty():
            return now.select("word", "root")
        now = now.select("word", "root")


def group_variants(vocab: DataFrame, word_col: str = "word", count_col: str = "n", ratio: float = 2) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` for each distinct word of ``vocab``.

    Words are near if they differ by exactly one inserted, deleted or replaced code point. A word's
    form is its most frequent near word, the smallest of equal ones, if that is at least ``ratio``
    (over 1) times as frequent, else null; its root follows forms to the last. Counts of repeated
    words are added up, null words and null counts ignored; other columns are ignored, so their names
    can't clash; an empty table gives no rows. No near word is left out: keys that many words share
    are dealt over tasks in pairs of slices.
    """
    if ratio <= 1:
        raise ValueError("ratio must be over 1, or forms could go in circles")
    run = Scratch(vocab.sparkSession, "spelling")
    words = vocab.select(col(word_col).alias("word"), col(count_col).cast("bigint").alias("n")).where("word IS NOT NULL AND n IS NOT NULL")
    words = run.written(words.groupBy("word").agg(F.sum("n").alias("n")), "words")
    fits = F.col("best_n") >= ratio * F.col("n")
    formed = words.join(_near(words, run), "word", "left").select(
        "word", F.when(fits, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), F.when(fits, F.col("best_n")).alias("form_n")
    )
    formed = run.written(formed, "formed")
    roots = _roots(formed.where("form IS NOT NULL"), run)
    out = written(formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"), "variants")
    run.drop()
    return out
