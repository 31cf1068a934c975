"""Seeded samples and splits by the order of a hash; exact sizes, the same on every run and partitioning.

Places within a class are distributed prefix sums over ranges of the hash, so no task holds a class.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FOLDS = 5
#: Rows that a range of the hash holds on average, at most, and the least number of leading hex digits that make a range.
RANGE_ROWS = 1 << 18
RANGE_DIGITS = 2
#: Rows that a task orders, about, at most.
TASK_ROWS = 1 << 19


def order_key(seed: int, row_id: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), row_id.cast("string")))


def range_digits(n: int) -> int:
    """Hex digits that make enough ranges for ``n`` rows."""
    digits = RANGE_DIGITS
    while n > RANGE_ROWS * 16**digits:
        digits += 1
    return digits


def placed(df: DataFrame, y: str, row_id: str, seed: int, out: str = "place", n: int | None = None) -> DataFrame:
    """Adds the row's place, from 1, in its class's random order. ``n``, the number of rows, decides the ranges' number and no place."""
    n = df.count() if n is None else n
    digits = range_digits(n)
    tasks = math.ceil(n / TASK_ROWS)
    keyed = df.withColumn("__key", order_key(seed, F.col(row_id))).withColumn("__range", F.substring("__key", 1, digits))
    counts = keyed.groupBy(y, "__range").agg(F.count(F.lit(1)).alias("__n"))
    earlier = Window.partitionBy(y).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col(y).alias("__y"), F.col("__range").alias("__r"), F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    inside = Window.partitionBy(y, "__range").orderBy("__key", row_id)
    if tasks > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        keyed = keyed.repartition(tasks, y, "__range")
    joined = keyed.withColumn("__inside", F.row_number().over(inside)).join(F.broadcast(offsets), F.col(y).eqNullSafe(F.col("__y")) & (F.col("__range") == F.col("__r")))
    return joined.withColumn(out, (F.col("__before") + F.col("__inside")).cast("long")).drop("__key", "__range", "__n", "__y", "__r", "__before", "__inside")


def train_counts(sizes: dict, test_size: float) -> dict:
    """Training rows of each class: shares of n - ceil(n * test_size), rounded down, the rest by largest remainder, then class."""
    n = sum(sizes.values())
    n_train = n - math.ceil(n * test_size)
    exact = {c: k * n_train / n for c, k in sizes.items()}
    out = {c: math.floor(x) for c, x in exact.items()}
    by_rest = sorted(exact, key=lambda c: (-(exact[c] - math.floor(exact[c])), c))
    for c in by_rest[: n_train - sum(out.values())]:
        out[c] += 1
    return out


def stratified(df: DataFrame, y: str, row_id: str, test_size: float = 0.2, seed: int = 42) -> DataFrame:
    """Adds is_test and split_pos, the row's place in its class's order.

    Raises if a class has a single row, or if either side would have fewer rows than classes. With one class the
    split is not stratified, which is the same thing.
    """
    sizes = dict(df.groupBy(y).count().collect())  # a row for each class
    n, classes = sum(sizes.values()), len(sizes)
    if classes > 1:
        if min(sizes.values()) < 2:
            raise ValueError("the least populated class has one row only; a stratified split needs two")
        n_test = math.ceil(n * test_size)
        if n_test < classes or n - n_test < classes:
            raise ValueError("a side of the split would have fewer rows than there are classes")
    keep = train_counts(sizes, test_size) if n else {}
    limit = F.create_map(*[F.lit(x) for c, k in keep.items() for x in (c, k)]) if keep else F.create_map(F.lit(0), F.lit(0))
    return placed(df, y, row_id, seed, "split_pos", n).withColumn("is_test", F.col("split_pos") > F.element_at(limit, F.col(y)))


def folds(df: DataFrame, y: str, row_id: str, k: int = FOLDS, seed: int = 0, out: str = "fold") -> DataFrame:
    """Adds a fold from 0 to k - 1; each class's counts differ by one at most."""
    return placed(df, y, row_id, seed, out).withColumn(out, ((F.col(out) - 1) % k).cast("int"))


def background(df: DataFrame, row_id: str, n: int = 100, seed: int = 0) -> DataFrame:
    """A random sample of at most ``n`` rows."""
    return df.orderBy(order_key(seed, F.col(row_id)), row_id).limit(n)


def first_rows(df: DataFrame, order: str, n: int = 100) -> DataFrame:
    return df.orderBy(order).limit(n)
