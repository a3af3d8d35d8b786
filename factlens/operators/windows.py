"""Row caps, running budgets and normalisation by key. No window over data is without a partition."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window as W, functions as F, types as T


def cap_per_key(df: DataFrame, keys: list[str], order: list[Column | str], n: int) -> DataFrame:
    """The first n rows of each key; Spark prunes to n already before the shuffle."""
    return df.withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("__n") <= n).drop("__n")


def split_points(df: DataFrame, cols: list[str], parts: int = 256) -> Column:
    """Up to parts - 1 rows of (cols) in order, as an array of structs, between which about as many rows of df lie. They are read off a sample by hash
    of at most 64 a part; a poor one makes parts uneven, and nothing else."""
    every = max(1, df.count() // (16 * parts))
    seen = df.select(*cols).where(F.pmod(F.xxhash64(*cols), F.lit(every)) == 0).distinct().limit(64 * parts)
    rows = seen.orderBy(*cols).select(F.to_json(F.struct(*cols))).collect()
    places = dict.fromkeys(len(rows) * i // parts for i in range(1, parts)) if rows else ()
    return F.from_json(F.lit(f"[{','.join(rows[i][0] for i in places)}]"), T.ArrayType(seen.schema))  # Spark folds it to a literal


def part_of(cols: list[str], points: Column, step: int = 16) -> Column:
    """The number of split points below a row: every 16th is compared first, then those between two of them."""
    row = F.struct(*cols)
    coarse = F.filter(points, lambda p, i: (i % step == 0) & (p < row))
    start = F.greatest(F.size(coarse) - 1, F.lit(0)) * step
    return start + F.size(F.filter(F.slice(points, start + 1, F.lit(step)), lambda p: p < row))


def running_budget(df: DataFrame, keys: list[str], order: list[str], amount: Column, cap: int, parts: int = 256) -> DataFrame:
    """Rows as long as the running sum of their key, in ascending order of columns, stays in the budget; adds `used`.

    A prefix sum in two steps, since one key may hold a third of all rows: rows are dealt by split points of (keys, order) into parts in order; what
    lies before a part in a key whose rows are in several comes from the sums of these parts, fewer than `parts` rows in all, and each window is
    over one key's rows in one part. Only rows that are equal in keys and order are never parted. Nulls are first, as a key and in the order.
    """
    cols = [*keys, *order]
    dealt = df.withColumns({"__part": part_of(cols, split_points(df, cols, parts)), "__amount": amount})
    sums = dealt.groupBy(*keys, "__part").agg(F.sum("__amount").alias("__sum"))
    earlier = W.partitionBy(*keys).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    before = sums.withColumn("__before", F.sum("__sum").over(earlier)).where("__before is not null")
    renamed = before.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("__part").alias("__later"), "__before")
    same = reduce(lambda x, k: x & F.col(k).eqNullSafe(F.col(f"__{k}")), keys, F.col("__part") == F.col("__later"))
    frame = W.partitionBy(*keys, "__part").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    running = dealt.join(F.broadcast(renamed), same, "left").withColumn("used", F.coalesce("__before", F.lit(0)) + F.sum("__amount").over(frame))
    return running.where(F.col("used") <= cap).select(*df.columns, "used")


def global_budget(df: DataFrame, key: str, order: list[str], amount: Column, cap: int, parts: int = 256) -> DataFrame:
    """A running budget over all rows in order of key and order; adds `used`. The one window over all parts has `parts` rows."""
    return running_budget(df, [], [key, *order], amount, cap, parts)


def minmax(df: DataFrame, by: list[str], c: str, out: str) -> DataFrame:
    """c scaled to 0..1 within its group; a group of one value gives 1."""
    bounds = df.groupBy(*by).agg(F.min(c).alias("__lo"), F.max(c).alias("__hi"))
    span = F.col("__hi") - F.col("__lo")
    return df.join(bounds, by).withColumn(out, F.when(F.col(c).isNull(), None).when(span == 0, 1.0).otherwise((F.col(c) - F.col("__lo")) / span)).drop("__lo", "__hi")


def top_sources(df: DataFrame, keys: list[str], source: list[str], n: int = 8) -> DataFrame:
    """The first n different sources of each key, as one text."""
    one = df.select(*keys, *source).distinct()
    ref = F.concat_ws(":", *[F.col(s).cast("string") for s in source])
    ranked = one.withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy(*source))).where(F.col("__n") <= n)
    return ranked.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__n", ref.alias("r")))), lambda s: s["r"]), ",").alias("sources"))


def page(df: DataFrame, order: list[Column | str], size: int = 20, offset: int = 0, total: bool = True) -> DataFrame:
    """A page of rows in order; with `total`, a column that says how many rows there are in all, observed by the pass that finds the page. That
    pass runs here, and the page's rows, `size` at most, come to the driver."""
    if not total:
        return df.orderBy(*order).offset(max(0, offset)).limit(max(1, size))
    seen = Observation()
    found = df.observe(seen, F.count(F.lit(1)).alias("total")).orderBy(*order).offset(max(0, offset)).limit(max(1, size))
    rows = found.collect()
    return df.sparkSession.createDataFrame(rows, found.schema).withColumn("total", F.lit(seen.get["total"]).cast("long"))


def after(df: DataFrame, key: list[str], last: list | None, size: int = 20) -> DataFrame:
    """The next page in ascending order of a key, behind the key that the last one ended with: rows before it are filtered out, not sorted again."""
    if last is not None:
        behind = F.lit(False)
        for i, c in enumerate(key):
            same = reduce(lambda x, j: x & (F.col(key[j]) == F.lit(last[j])), range(i), F.lit(True))
            behind = behind | (same & (F.col(c) > F.lit(last[i])))
        df = df.where((F.col(key[0]) >= F.lit(last[0])) & behind)
    return df.orderBy(*key).limit(max(1, size))
