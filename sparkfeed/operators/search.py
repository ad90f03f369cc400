"""Populations of candidates: weighted draws, ranking, scoring, crossover and mutation."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.draws import h, integer, unit
from ..functions.index import dense_index
from ..functions.scalars import wrap_range


def top_candidates(df: DataFrame, k: int) -> DataFrame:
    return df.orderBy(F.desc("fitness"), "cand_id").limit(k)


def weighted_sample(df: DataFrame, weight: str, n: int, seed=0, buckets: int | None = None) -> DataFrame:
    """``n`` draws with replacement, in proportion to ``weight``: ``(draw, cand_id)``.

    Shares add up along the ids; draws meet the intervals ``(lo, hi]`` by equal buckets of the unit
    interval, as many as there are candidates up to a million, so the range join is an equi join.
    """
    buckets = buckets or max(1, min(1 << 20, df.count()))
    ordered = dense_index(df.select("cand_id", F.col(weight).cast("double").alias("w")), ["cand_id"], "_k")
    # totals of runs of rows, so that the ordered window is over few rows
    run = F.floor(F.col("_k") / 4096)
    inner = F.sum("w").over(W.partitionBy("_r").orderBy("_k"))
    rows = ordered.withColumn("_r", run).withColumn("_in", inner)
    totals = rows.groupBy("_r").agg(F.sum("w").alias("t"))
    ahead = totals.select("_r", F.coalesce(F.sum("t").over(W.orderBy("_r").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)).alias("_a"))
    total = totals.agg(F.sum("t").alias("_all"))
    spans = rows.join(ahead, "_r").crossJoin(F.broadcast(total)).select("cand_id", ((F.col("_a") + F.col("_in") - F.col("w")) / F.col("_all")).alias("lo"), ((F.col("_a") + F.col("_in")) / F.col("_all")).alias("hi"))
    spans = spans.select("*", F.explode(F.sequence(F.floor(F.col("lo") * buckets), F.floor(F.col("hi") * buckets))).alias("b"))
    draws = df.sparkSession.range(n).select(F.col("id").alias("draw"), unit(h(seed, F.col("id"))).alias("u")).withColumn("b", F.floor(F.col("u") * buckets))
    # 0 itself belongs to the first interval
    hit = ((F.col("u") > F.col("lo")) | ((F.col("u") == 0) & (F.col("lo") == 0))) & (F.col("u") <= F.col("hi"))
    return draws.join(spans, "b").where(hit).select("draw", "cand_id")


def sample_with_replacement(df: DataFrame, n: int, seed=0) -> DataFrame:
    """``n`` rows drawn evenly: ``(draw, cand_id)``."""
    size = df.count()
    placed = dense_index(df.select("cand_id"), ["cand_id"], "k")
    draws = df.sparkSession.range(n).select(F.col("id").alias("draw"), integer(seed, F.col("id"), size).alias("k"))
    return draws.join(placed, "k").select("draw", "cand_id")


def tournament(df: DataFrame, seed=0, share: float = 0.5, keep: float = 0.1, best: str = "low") -> DataFrame:
    """Of ``share n`` rows drawn with replacement, the ``keep n`` of lowest (or highest) fitness."""
    n = df.count()
    drawn = sample_with_replacement(df, int(share * n), seed).join(df.select("cand_id", "fitness"), "cand_id")
    order = F.col("fitness") if best == "low" else F.desc("fitness")
    return drawn.orderBy(order, "cand_id", "draw").limit(int(keep * n)).select("draw", "cand_id", "fitness")


def score_candidates(cands: DataFrame, data: DataFrame, expr: Column, most: int = 10_000) -> DataFrame:
    """``(cand_id, fitness)``: an aggregate of the data for each candidate's parameters.

    Candidates go to the data in blocks of about ``most``, each broadcast; a task adds up its rows for
    a block's candidates before anything is shuffled. A candidate whose expression fails fails the job.
    """
    blocks = -(-cands.count() // most)
    parts = [cands.where(F.pmod(F.xxhash64("cand_id"), F.lit(blocks)) == k) for k in range(blocks)] if blocks > 1 else [cands]
    out = None
    for part in parts:
        scored = data.crossJoin(F.broadcast(part)).groupBy("cand_id").agg(expr.alias("fitness"))
        out = scored if out is None else out.unionByName(scored)
    return out


def fitness(df: DataFrame, expr: Column | None = None) -> DataFrame:
    """``df (validation, train)`` with ``fitness``: a user's expression of the two metrics, by default the first."""
    return df.withColumn("fitness", F.col("validation") if expr is None else expr)


def _gene_draw(seed, key: str, i: Column, what: str) -> Column:
    return unit(F.md5(F.concat_ws("|", F.lit(f"{seed}{what}"), F.col(key), i)))


def crossover(pairs: DataFrame, kind: str, seed=0, low: float | None = None, high: float | None = None) -> DataFrame:
    """Children of parents ``(pair, a, b)`` of genes: ``uniform`` takes each gene from either;
    ``arithmetic`` mixes each gene by a weight of its own, and has a mirror child; ``geometric``
    multiplies powers that add up to one, genes within ``low`` and ``high`` being moved or turned
    round first so that none is negative."""
    draw = lambda i: unit(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("pair"), i)))
    if kind == "uniform":
        child = F.transform("a", lambda x, i: F.when(draw(i) < 0.5, x).otherwise(F.get("b", i)))
        return pairs.select("pair", F.lit(0).alias("child"), child.alias("genes"))
    if kind == "arithmetic":
        mix = lambda first, second: F.transform(first, lambda x, i: draw(i) * x + (1 - draw(i)) * F.get(second, i))
        return pairs.select("pair", F.posexplode(F.array(mix("a", "b"), mix("b", "a"))).alias("child", "genes"))
    if kind == "geometric":
        if low is None or high is None:
            raise ValueError("geometric crossover needs the range of the genes")
        turn = -1 if high < 0 else 1
        move = 0 if low > 0 or turn < 0 else -low
        child = F.transform("a", lambda x, i: turn * (F.pow(turn * x + move, draw(i)) * F.pow(turn * F.get("b", i) + move, 1 - draw(i)) - move))
        return pairs.select("pair", F.lit(0).alias("child"), child.alias("genes"))
    raise ValueError(f"no crossover of kind {kind!r}")


def mutate(df: DataFrame, kind: str, low: float, high: float, prob: float, seed=0, share: float = 1.0, points: int | None = None) -> DataFrame:
    """Genes changed in a ``share`` of the rows, in ``points`` places of each (all by default), each
    with probability ``prob``.

    ``uniform`` draws a gene anew from the range; ``gaussian`` adds or takes a normal draw (mean in the
    middle of the range, variance a sixth of it) and wraps it into the range; ``swap`` exchanges it
    with another; ``flip`` turns a bit, 0 or 1.
    """
    n, span = F.size("genes"), high - low
    at = lambda i, what: _gene_draw(seed, "cand_id", i, what)
    # the places of smallest draw are those that may change
    chosen = F.slice(F.transform(F.array_sort(F.transform("genes", lambda x, i: F.struct(at(i, "o").alias("o"), i.alias("i")))), lambda s: s["i"]), 1, n if points is None else points)
    hit = lambda i: F.array_contains(F.col("_at"), i) & (at(i, "p") < prob)
    if kind == "uniform":
        changed = F.transform("genes", lambda x, i: F.when(hit(i), low + at(i, "v") * span).otherwise(x))
    elif kind == "gaussian":
        z = lambda i: F.sqrt(-2 * F.log(1 - at(i, "u"))) * F.cos(2 * math.pi * at(i, "v"))
        step = lambda i: (low + span / 2 + math.sqrt(span / 6) * z(i)) * F.when(at(i, "s") < 0.5, -1).otherwise(1)
        changed = F.transform("genes", lambda x, i: F.when(hit(i), wrap_range(x + step(i), low, high)).otherwise(x))
    elif kind == "swap":
        swaps = F.filter("_at", lambda i: at(i, "p") < prob)

        def exchange(genes: Column, i: Column) -> Column:
            j = F.floor(at(i, "v") * n).cast("int")
            return F.transform(genes, lambda x, k: F.when(k == i, F.get(genes, j)).when(k == j, F.get(genes, i)).otherwise(x))

        changed = F.aggregate(swaps, F.col("genes"), exchange)
    elif kind == "flip":
        changed = F.transform("genes", lambda x, i: F.when(hit(i), 1 - x).otherwise(x))
    else:
        raise ValueError(f"no mutation of kind {kind!r}")
    taken = unit(F.md5(F.concat_ws("|", F.lit(f"{seed}r"), F.col("cand_id")))) < share
    return df.withColumn("_at", chosen).withColumn("genes", F.when(taken, changed).otherwise(F.col("genes"))).drop("_at")


def mutate_uniform(df: DataFrame, low: float, high: float, prob: float, seed=0) -> DataFrame:
    """Each gene redrawn from the range with probability ``prob``."""
    return mutate(df, "uniform", low, high, prob, seed)
