"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import KeyFilter, col, fresh, spread_join, written

#: What two texts may differ in and still be equal.
SPACES = r"[\x20\x09-\x0D]+"
#: Characters of the normalised text that the prefix hash reads.
PREFIX = 128


def normalised(text: Column) -> Column:
    """The text without white space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, "")


def refined_keys(docs: DataFrame, id_col: str, text_col: str, prefix: int = PREFIX) -> tuple[DataFrame, list[str]]:
    """``docs`` with four more columns, and their names.

    These are the normalised length, the code points of the original, the prefix hash, and the
    SHA-256 of the normalised text, which only rows have whose length and prefix others share too.

    Only lengths and hashes are shuffled for grouping, and all counts are summed up before the
    shuffle, so a group that holds a third of all rows is a few rows for each task.
    """
    key = docs.select(col(id_col).alias("id"), normalised(col(text_col)).alias("norm"), F.length(F.coalesce(col(text_col), F.lit(""))).alias("cp"))
    narrow = written(key.select(F.length("norm").alias("len"), F.xxhash64(F.substring("norm", 1, prefix)).alias("head")).groupBy("len", "head").agg(F.count("*").alias("n")), "dedup-heads")
    lengths = narrow.groupBy("len").agg(F.sum("n").alias("n")).where("n > 1").select("len")
    shared = narrow.where("n > 1").join(lengths, "len", "left_semi")
    bits = KeyFilter(shared, F.struct("len", "head"))

    norm, length, cp, head, full, hot = fresh(docs, "sf_norm", "sf_len", "sf_cp", "sf_head", "sf_full", "sf_hot")
    rows = docs.withColumn(norm, normalised(col(text_col))).withColumns(
        {length: F.length(col(norm)), cp: F.length(F.coalesce(col(text_col), F.lit(""))), head: F.xxhash64(F.substring(col(norm), 1, prefix))}
    )
    # a row that the filter lets through by chance gets a hash that no other row has
    keyed = bits.maybe(rows, F.struct(col(length).alias("len"), col(head).alias("head")), hot)
    return keyed.withColumn(full, F.when(col(hot), F.sha2(col(norm), 256))).drop(norm, hot), [length, cp, head, full]


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = PREFIX, carry: list[str] | None = None) -> DataFrame:
    """``(id, keep_id, group_size, kept, content_hash)``, a row for each row of ``docs``.

    Texts are equal when they are so without white space; of equal texts the row with the most code
    points, then the smallest id (null last) stays. Rows with equal id and length of a group are
    interchangeable: one of them is ``kept``. Null and empty texts are equal to each other.
    ``content_hash`` is null where length or prefix already tell a text from all others. Other
    columns of ``docs`` are ignored but for those in ``carry``, functions of the text that come along;
    an empty table gives no rows.
    """
    carry = carry or []
    source = docs.select(col(id_col).alias("id"), col(text_col).alias("text"), *map(col, carry))
    keyed, (length, cp, head, full) = refined_keys(source, "id", "text", prefix)
    # interchangeable rows as one with a count; written, as it is read twice
    ids = written(keyed.groupBy("id", cp, length, head, full, *carry).agg(F.count("*").alias("times")), "dedup-keys")
    groups = _winners(ids, length, cp, head, full)
    alone = ids.where(col(full).isNull()).select("id", F.col("id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("best"), "times", F.lit(None).cast("string").alias("hash"), *carry)
    joined = spread_join(ids.where(col(full).isNotNull()), groups, full, F.col("id"))
    grouped = joined.select("id", F.col("keep.id").alias("keep_id"), "group_size", (F.col("id").eqNullSafe(F.col("keep.id")) & (-col(cp) == F.col("keep.cp"))).alias("best"), "times", col(full).alias("hash"), *carry)
    both = alone.unionByName(grouped).withColumn("turn", F.explode(F.sequence(F.lit(1).cast("bigint"), "times")))
    return both.select(F.col("id").alias(id_col), "keep_id", "group_size", (F.col("best") & (F.col("turn") == 1)).alias("kept"), F.col("hash").alias("content_hash"), *carry)


def _winners(ids: DataFrame, length: str, cp: str, head: str, full: str) -> DataFrame:
    """The row that stays, and the size, of each group of equal texts."""
    order = F.struct((-col(cp)).alias("cp"), F.col("id").isNull().alias("no_id"), F.col("id").alias("id"))
    return ids.where(col(full).isNotNull()).groupBy(full).agg(F.min(F.struct(order.alias("o"), F.col("times").alias("times"))).alias("best"), F.sum("times").alias("group_size")).select(
        full, F.col("best.o").alias("keep"), F.col("best.times").alias("ties"), "group_size"
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = PREFIX) -> DataFrame:
    """The rows of ``docs`` that stay, with their own columns; the rules are those of ``exact_duplicates``.

    Extra columns, whatever their names, go through; an empty table stays one."""
    keyed, (length, cp, head, full) = refined_keys(docs, id_col, text_col, prefix)
    ids = written(keyed.select(col(id_col).alias("id"), cp, length, head, full).groupBy("id", cp, length, head, full).agg(F.count("*").alias("times")), "dedup-keys")
    keep, ties, key, hot = fresh(keyed, "sf_keep", "sf_ties", "sf_key", "sf_hot")
    winners = written(_winners(ids, length, cp, head, full).where("group_size > 1").select(col(full).alias(key), F.col("keep").alias(keep), F.col("ties").alias(ties)), "dedup-groups")
    own = list(map(col, docs.columns))
    rows = docs.withColumns({cp: F.length(F.coalesce(col(text_col), F.lit(""))), full: F.sha2(normalised(col(text_col)), 256)})
    # only rows of groups of two or more are shuffled
    rows = KeyFilter(winners, col(key)).maybe(rows, col(full), hot)
    marks = winners.withColumns({full: col(key)})
    found = spread_join(rows.where(col(hot)), marks, full, col(id_col), "left", like=ids.where(col(full).isNotNull()))
    best = col(key).isNull() | (col(id_col).eqNullSafe(col(keep)["id"]) & (-col(cp) == col(keep)["cp"]))
    # about one row a group, written so that texts are shuffled once
    found = written(found.where(best).select(*own, key, ties), "dedup-found")
    single = found.where(col(key).isNull() | (col(ties) == 1)).select(*own)
    # repeated rows that are alike in all that decides: one of each group
    tied = found.where(col(key).isNotNull() & (col(ties) > 1)).dropDuplicates([key]).select(*own)
    return rows.where(~col(hot)).select(*own).unionByName(single).unionByName(tied)


def with_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = PREFIX) -> DataFrame:
    """``exact_duplicates`` with ``text_sha256`` of each normalised text in place of the content hash.

    The refinement alone decides what is equal; a digest of a text that it told apart early is only
    carried along.
    """
    (digest,) = fresh(docs, "text_sha256")
    source = docs.select(col(id_col).alias("id"), col(text_col).alias("text")).withColumn("digest", F.sha2(normalised(F.col("text")), 256))
    return exact_duplicates(source, "id", "text", prefix, carry=["digest"]).select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.coalesce("content_hash", "digest").alias(digest))
