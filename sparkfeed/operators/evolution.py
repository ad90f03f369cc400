"""Candidates evaluated with their failures, and bred over generations."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any, NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.draws import h, integer
from ..functions.index import dense_index
from ..functions.scratch import Scratch, written
from .search import crossover, mutate, weighted_sample

#: Candidates of a block at most: a block goes to every task of the data.
BLOCK = 10_000

#: What a user gives to score a candidate: ``(parameters, rows)`` to numbers that can be added up.
Part = Callable[[dict[str, Any], pd.DataFrame], list[float]]


def _sums(cands: list[dict[str, Any]], key: str, f: Part) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(frames):
        sums: dict[Any, list[float]] = {}
        errors: dict[Any, str] = {}
        for frame in frames:
            for c in cands:
                k = c[key]
                if k in errors or not len(frame):
                    continue
                try:
                    made = [float(x) for x in f(c, frame)]
                    sums[k] = made if k not in sums else [a + b for a, b in zip(sums[k], made, strict=True)]
                except Exception as e:  # any failure of the user's function is that candidate's own
                    errors[k] = f"{type(e).__name__}: {e}"
        rows = [(k, None, e) for k, e in errors.items()] + [(k, s, None) for k, s in sums.items() if k not in errors]
        yield pd.DataFrame(rows, columns=["k", "sums", "error"])

    return run


def evaluate_candidates(cands: DataFrame, data: DataFrame, f: Part, fitness: Callable[[Column], Column], key: str = "cand_id", attempts: int = 1, most: int = BLOCK) -> DataFrame:
    """``(cand_id, fitness, error)`` of each candidate over all rows of ``data``.

    ``f(parameters, rows)`` turns a batch of rows into numbers, which are added up over batches, tasks
    and then by ``fitness`` of their array: a task holds a batch and the sums of a block of ``most``
    candidates. A candidate for which ``f`` raises, or whose fitness can't be told, has null fitness
    and says why in ``error``; others are not touched by it. With several ``attempts``, those that
    failed are evaluated again, and only they. Keys are unique; without any data each candidate fails.
    """
    spark, kind = cands.sparkSession, cands.schema[key].dataType.simpleString()
    run, done, left = Scratch(spark, "evaluate"), None, cands
    for attempt in range(attempts):
        blocks = max(1, -(-left.count() // most))
        scored = None
        for block in range(blocks):
            some = left.where(F.pmod(F.xxhash64(key), F.lit(blocks)) == block)
            rows = [r.asDict(recursive=True) for r in some.collect()]
            summed = data.mapInPandas(_sums(rows, key, f), f"k {kind}, sums array<double>, error string")
            places = summed.select("k", "error", F.posexplode_outer("sums").alias("place", "v"))
            by_place = places.groupBy("k", "place").agg(F.sum("v").alias("v"), F.max("error").alias("error"))
            whole = by_place.groupBy("k").agg(F.transform(F.sort_array(F.collect_list(F.when(F.col("place").isNotNull(), F.struct("place", "v")))), lambda s: s["v"]).alias("sums"), F.max("error").alias("error"))
            part = some.select(key).join(whole.withColumnRenamed("k", "sf_k"), F.col(key) == F.col("sf_k"), "left")
            part = part.select(key, F.when(F.col("error").isNull(), fitness(F.col("sums"))).alias("fitness"), "error")
            scored = part if scored is None else scored.unionByName(part)
        scored = scored.withColumn("error", F.coalesce("error", F.when(F.col("fitness").isNull() | F.isnan("fitness"), "no fitness")))
        scored = run.written(scored.withColumn("fitness", F.when(F.col("error").isNull(), F.col("fitness"))), "scored")
        last = attempt + 1 == attempts
        fine = scored if last else scored.where("error IS NULL")
        done = fine if done is None else done.unionByName(fine)
        if last or scored.where("error IS NOT NULL").isEmpty():
            break
        left = run.written(cands.join(scored.where("error IS NOT NULL").select(key), key, "left_semi"), "left")
    out = written(done, "evaluated")
    run.drop()
    return out


class Breeding(NamedTuple):
    """Shares of the population that are crossed or changed in a generation, and how likely; fixed values."""

    parents: float = 0.75
    crossings: tuple[tuple[str, float], ...] = (("uniform", 0.15), ("arithmetic", 0.15), ("geometric", 0.2))
    mutations: tuple[tuple[str, float, float, float], ...] = (("gaussian", 0.35, 0.05, 0.7), ("uniform", 0.35, 0.05, 0.7))


class Evolution(NamedTuple):
    """The last population ``(cand_id, genes, fitness)``, and a row a generation of what it was like."""

    population: DataFrame
    history: DataFrame


HISTORY = "generation int, sum double, average double, best double, worst double, median double, failed bigint, stop boolean"


def breed(top: DataFrame, size: int, generation: int, first: int, low: float, high: float, seed, how: Breeding, run: Scratch) -> DataFrame:
    """Children ``(cand_id, genes)`` of the ranked population ``top (cand_id, genes, fitness)``.

    Parents are drawn in proportion to their fitness, which must not be negative. Each kind of
    crossing takes pairs of them, evenly; each kind of mutation takes other members of ``top`` and
    changes copies of them. Draws are hashes of seed, generation and place; ids go on from ``first``.
    """
    tag = f"{seed}.{generation}"
    many = int(how.parents * size)
    drawn = weighted_sample(top, "fitness", many, seed=f"{tag}:p")
    parents = run.written(drawn.join(top.select("cand_id", "genes"), "cand_id").select("draw", "genes"), "parents")
    spark, out = top.sparkSession, []
    for k, (kind, share) in enumerate(how.crossings):
        pairs = spark.range(int(share * size)).select(F.col("id").alias("pair"), integer(f"{tag}:{kind}:a", F.col("id"), many).alias("i"), integer(f"{tag}:{kind}:b", F.col("id"), many).alias("j"))
        one = pairs.join(parents.select(F.col("draw").alias("i"), F.col("genes").alias("a")), "i").join(parents.select(F.col("draw").alias("j"), F.col("genes").alias("b")), "j").select("pair", "a", "b")
        children = crossover(one, kind, f"{tag}:{kind}", low, high)
        out.append(children.select((first + k * size + 2 * F.col("pair") + F.col("child")).cast("bigint").alias("cand_id"), "genes"))
    for k, (kind, share, points, prob) in enumerate(how.mutations):
        some = top.select("cand_id", "genes", h(f"{tag}:{kind}", F.col("cand_id")).alias("h")).orderBy("h", "cand_id").limit(int(share * size))
        changed = mutate(some.select("cand_id", "genes"), kind, low, high, prob, seed=f"{tag}:{kind}", points=int(points * size))
        placed = dense_index(changed, ["cand_id"], "place")
        out.append(placed.select((first + 3 * size + k * (size // 2) + F.col("place")).alias("cand_id"), "genes"))
    both = out[0]
    for part in out[1:]:
        both = both.unionByName(part)
    return both


def evolve(population: DataFrame, evaluate: Callable[[DataFrame], DataFrame], low: float, high: float, size: int, generations: int, seed=0, how: Breeding = Breeding()) -> Evolution:
    """Generations of ``population (cand_id, genes)``, whose genes lie between ``low`` and ``high``.

    ``evaluate`` gives ``(cand_id, fitness)`` of candidates, and ``error`` if it likes; higher is
    better, and who has none drops out. A generation is ranked, cut to ``size``, told in ``history``,
    and bred; old and new compete in the next. It stops when sum, mean, best, worst and median have
    all failed to grow, or after ``generations``. Each generation is a written table, from which a
    lost executor's work is done again; only the one row of figures comes to the driver.
    """
    spark, run, rows, before = population.sparkSession, Scratch(population.sparkSession, "evolve"), [], None
    kind = "array<double>"

    def scored(cands: DataFrame) -> DataFrame:
        cands = run.written(cands.select(F.col("cand_id").cast("bigint").alias("cand_id"), F.col("genes").cast(kind).alias("genes")), "candidates")
        return run.written(cands.join(evaluate(cands).select("cand_id", F.col("fitness").cast("double").alias("fitness")), "cand_id", "left"), "scored")

    new, top = scored(population), None
    first = (new.agg(F.max("cand_id")).first()[0] or 0) + 1
    for generation in range(generations):
        failed = new.where("fitness IS NULL OR isnan(fitness)").count()
        fine = new.where("fitness IS NOT NULL AND NOT isnan(fitness)")
        every = fine if top is None else fine.unionByName(top)
        ranked = dense_index(every, [F.desc("fitness"), F.col("cand_id")], "place").where(F.col("place") < size)
        placed = run.written(ranked, "ranked")
        top = placed.drop("place")
        figures = placed.agg(F.sum("fitness").alias("sum"), F.avg("fitness").alias("average"), F.max("fitness").alias("best"), F.min("fitness").alias("worst"), F.count("*").alias("n"))
        median = F.max(F.when(F.col("place") == F.floor(F.col("n") / 2), F.col("fitness"))).alias("median")
        now = placed.crossJoin(F.broadcast(figures)).groupBy("sum", "average", "best", "worst", "n").agg(median).first()
        if now is None:
            break
        five = [now[c] for c in ("sum", "average", "best", "worst", "median")]
        stop = before is not None and all(a >= b for a, b in zip(before, five, strict=True))
        rows.append((generation, *five, failed, stop))
        before = five
        if stop or generation + 1 == generations:
            break
        new = scored(breed(top, now["n"], generation, first + 4 * size * generation, low, high, seed, how, run))
    result = written(top if top is not None else new.limit(0), "population")
    run.drop()
    return Evolution(result, spark.createDataFrame(rows, HISTORY))
