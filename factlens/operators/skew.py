"""Joins of rows with what is known of their key, where one key may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: Keys that are looked at as hot ones at most; any other holds less than one in so many of the rows.
HOT_KEYS = 1000


def join_key(rows: DataFrame, per_key: DataFrame, keys: list[str], row_id: str = "record_id", least: int = 10_000, spread: int = 64) -> DataFrame:
    """Inner join of rows with one row a key, which has the key's number of rows as `n`; columns of `per_key` but keys and n are added.

    The commonest keys (HOT_KEYS at most, of `least` rows at least) are broadcast with their row. Rows of such a key have found theirs then, and go to the join
    of the others under a salt, by which they meet nothing and spread over its tasks. So no task gets more than the rows of a key that is not hot.
    """
    added = [c for c in per_key.columns if c not in (*keys, "n")]
    hot = per_key.orderBy(F.desc("n"), *keys).limit(HOT_KEYS).where(F.col("n") >= least)
    hot = hot.select(*keys, F.struct(*added).alias("__hot"))
    marked = rows.join(F.broadcast(hot), keys, "left").withColumn("__salt", F.when(F.col("__hot").isNotNull(), F.pmod(F.xxhash64(row_id), F.lit(spread)) + 1).otherwise(F.lit(0)))
    # Always 0, but no literal: Spark would take that for a condition on the rows and join by the key alone.
    cold = per_key.select(*keys, F.pmod(F.xxhash64(*keys), F.lit(1)).alias("__salt"), F.struct(*added).alias("__cold"))
    met = marked.join(cold, [*keys, "__salt"], "left").withColumn("__found", F.coalesce("__hot", "__cold")).where("__found is not null")
    return met.select(*rows.columns, *[F.col(f"__found.{c}").alias(c) for c in added])
