"""Imputes, encodes and scales a typed table.

Statistics are taken for all columns at once and become literals of one projection: no joins but for columns of very many levels, and Spark prunes what is
not used.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabularium.functions.expressions import is_numeric, is_text, kind_of, label, quoted, to_number, unused
from tabularium.functions.storage import drop, materialise
from tabularium.operators.profile import BINARY, CATEGORICAL, NUMERICAL, TEXTUAL

#: Levels of a column up to which each becomes a column; beyond, the column holds the level's number, and the model takes it as a sparse vector.
MOST_LEVELS = 1000
NONE = "NA"


@dataclass
class Plan:
    """What becomes of each column: how it is filled, and the levels of those that are encoded."""

    types: dict[str, str]
    fill: dict[str, object] = field(default_factory=dict)
    levels: dict[str, list[str]] = field(default_factory=dict)
    features: list[str] = field(default_factory=list)
    scaled: list[str] = field(default_factory=list)
    source: dict[str, str] = field(default_factory=dict)
    means: dict[str, float] = field(default_factory=dict)
    deviations: dict[str, float] = field(default_factory=dict)
    indexed: dict[str, list[str]] = field(default_factory=dict)
    wide: dict[str, int] = field(default_factory=dict)
    places: dict[str, int] = field(default_factory=dict)
    numbers: DataFrame | None = None

    @property
    def columns(self) -> list[str]:
        """The columns of the matrix: a column of level numbers stands for all levels of each column in ``wide``."""
        return list(self.features)

    @property
    def n_features(self) -> int:
        """Every level of a wide column counts."""
        return len(self.features) + sum(self.wide.values()) - len(self.wide)

    def names(self, column: str) -> DataFrame:
        """(level, number) of a wide column."""
        return self.numbers.where(F.col("pos") == self.places[column]).select("level", "number")


_PARTS = ("whole", "real", "text")


def _counted(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """(pos, whole, real, text, n): the count of each expression's values, the value in the part of its type; null is no value."""
    kinds = {n: df.select(c.alias(n)).schema[0].dataType for n, c in columns.items()}
    cells = []
    for k, (n, c) in enumerate(columns.items()):
        kind = kinds[n].simpleString()
        part = "whole" if kind in ("tinyint", "smallint", "int", "bigint", "boolean") else "real" if kind in ("float", "double") else "text"
        cast = {"whole": "long", "real": "double", "text": "string"}
        cells.append(F.struct(F.lit(k).alias("pos"), *[(c if p == part else F.lit(None)).cast(cast[p]).alias(p) for p in _PARTS]))
    known = F.coalesce(*[F.col(f"x.{p}").cast("string") for p in _PARTS]).isNotNull()
    return df.select(F.explode(F.array(*cells)).alias("x")).where(known).groupBy("x.pos", *[f"x.{p}" for p in _PARTS]).agg(F.count(F.lit(1)).alias("n"))


def modes(df: DataFrame, columns: dict[str, Column]) -> dict[str, object]:
    """The most frequent value of each expression, the least of equals, null if all are null.

    Values are counted by (column, value), and each column's best is a minimum over these counts: no task holds a column's values.
    """
    if not columns:
        return {}
    best = _counted(df, columns).groupBy("pos").agg(F.min(F.struct(-F.col("n"), *_PARTS)).alias("best"))
    names, found = list(columns), dict.fromkeys(columns)
    for pos, row in best.collect():  # a row for each column
        found[names[pos]] = next(row[p] for p in _PARTS if row[p] is not None)
    return found


#: Values between two bounds that are sorted by the driver when a median lies among them.
FEW = 20_000


def medians(df: DataFrame, columns: dict[str, Column]) -> dict[str, float | None]:
    """The exact median of each expression, for all columns in a few passes that hold counts only.

    The median lies between two values. Each pass counts what is below, on and between them and draws them together by
    approximate quantiles, whose error is bounded, until few values are left between; these are counted and sorted.
    """
    if not columns:
        return {}
    names = {n: f"m{k}" for k, n in enumerate(columns)}
    rows = df.select(*[c.cast("double").alias(names[n]) for n, c in columns.items()])
    first = rows.agg(*[f(m).alias(f"{m}{p}") for m in names.values() for p, f in (("n", F.count), ("lo", F.min), ("hi", F.max))]).first()
    found = {n: None for n in names}
    wanted = {n: ((first[f"{m}n"] - 1) // 2, first[f"{m}n"] // 2) for n, m in names.items() if first[f"{m}n"]}
    bounds = {n: (first[f"{names[n]}lo"], first[f"{names[n]}hi"]) for n in wanted}
    known: dict[str, dict[int, float]] = {n: {} for n in wanted}
    while bounds:
        counts = _between(rows, {names[n]: b for n, b in bounds.items()})
        left: dict[str, int] = {}
        for n, (lo, hi) in bounds.items():
            below, on_lo, inside = counts[names[n]]
            for r in wanted[n]:
                if r not in known[n] and r < below + on_lo:
                    known[n][r] = lo
                elif r not in known[n] and r >= below + on_lo + inside:
                    known[n][r] = hi
            if any(r not in known[n] for r in wanted[n]):
                left[n] = inside
        for n in [n for n, k in left.items() if k <= FEW]:
            below, on_lo, _ = counts[names[n]]
            lo, hi = bounds[n]
            x = F.col(names[n])
            few = sorted(map(tuple, rows.where((x > lo) & (x < hi)).groupBy(x.alias("v")).count().collect()))  # at most FEW
            at = below + on_lo
            for v, k in few:
                known[n].update({r: v for r in wanted[n] if at <= r < at + k})
                at += k
        bounds = {n: b for n, b in bounds.items() if left.get(n, 0) > FEW}
        if bounds:
            bounds = _closer(rows, names, bounds, wanted, counts)
    return found | {n: (known[n][a] + known[n][b]) / 2 if a != b else known[n][a] for n, (a, b) in wanted.items()}


def _between(rows: DataFrame, bounds: dict[str, tuple[float, float]]) -> dict[str, tuple[int, int, int]]:
    """Of each column: how many values are below the lower bound, on it, and between the two."""
    count = lambda test: F.coalesce(F.sum(test.cast("long")), F.lit(0))
    stats = []
    for m, (lo, hi) in bounds.items():
        x = F.col(m)
        stats += [count(x < lo).alias(f"{m}b"), count(x == lo).alias(f"{m}l"), count((x > lo) & (x < hi)).alias(f"{m}i")]
    row = rows.agg(*stats).first()
    return {m: (row[f"{m}b"], row[f"{m}l"], row[f"{m}i"]) for m in bounds}


def _closer(rows: DataFrame, names: dict[str, str], bounds: dict[str, tuple[float, float]], wanted: dict[str, tuple[int, int]], counts: dict[str, tuple[int, int, int]], error: float = 0.001) -> dict[str, tuple[float, float]]:
    """Bounds of which the wanted places are still between or on them, with a hundredth of the values between at most, where values differ."""
    inside = rows.select(*[F.when((F.col(names[n]) > lo) & (F.col(names[n]) < hi), F.col(names[n])).alias(names[n]) for n, (lo, hi) in bounds.items()])
    out = {}
    shares = {n: [(r - counts[names[n]][0] - counts[names[n]][1]) / max(1, counts[names[n]][2]) for r in wanted[n]] for n in bounds}
    asked = {n: (max(0.0, min(s) - 4 * error), min(1.0, max(s) + 4 * error)) for n, s in shares.items()}
    points = sorted({p for pair in asked.values() for p in pair})
    quantiles = dict(zip(bounds, inside.approxQuantile([names[n] for n in bounds], points, error)))
    for n, (lo, hi) in bounds.items():
        low, high = asked[n]
        a, b = quantiles[n][points.index(low)], quantiles[n][points.index(high)]
        out[n] = (lo if low == 0.0 else a, hi if high == 1.0 else b)
    return out


def _number(df: DataFrame, name: str, values: Sequence[str] = ()) -> Column:
    """The column as a number; with ``values`` each text is its place among them."""
    if values:
        place = F.array_position(F.array(*map(F.lit, values)), F.col(quoted(name)))
        return F.when(place > 0, (place - 1).cast("double"))
    value = to_number(F.col(quoted(name)), kind_of(df, name))
    return F.when(~F.isnan(value), value)


def fitted(df: DataFrame, types: dict[str, str], scope: Column | None = None, most_levels: int = MOST_LEVELS, binary_strings: str = "number") -> Plan:
    """Fills and levels from the rows in ``scope``, all rows by default.

    A Binary column of texts becomes numbers like any other, so texts that are none fill with 0; with
    ``binary_strings="index"`` its two values become 0 and 1 in text order.
    """
    rows = df if scope is None else df.where(scope)
    plan = Plan(dict(types))
    of = lambda *kinds: [c for c, t in types.items() if t in kinds]
    texts = [c for c in of(BINARY) if binary_strings == "index" and is_text(kind_of(df, c))]
    if texts:
        plan.indexed = {c: sorted(v) for c, v in rows.agg(*[F.collect_set(quoted(c)).alias(c) for c in texts]).first().asDict().items()}
    wanted = {c: F.col(quoted(c)) for c in of(CATEGORICAL)} | {c: _number(df, c, plan.indexed.get(c, ())) for c in of(BINARY)}
    found = modes(rows, wanted) | medians(rows, {c: _number(df, c) for c in of(NUMERICAL)})
    plan.fill = {c: found[c] if found[c] is not None or types[c] == CATEGORICAL else 0.0 for c in found}
    if of(CATEGORICAL):
        _take_levels(rows, plan, {c: _level(df, c, plan) for c in of(CATEGORICAL)}, most_levels)
    for c, t in types.items():
        if t == TEXTUAL:
            continue
        names = [f"{c}_{v}" for v in plan.levels[c]] if c in plan.levels else [c]
        plan.features += names
        plan.source.update({n: c for n in names})
        plan.scaled += [] if t == CATEGORICAL else [c]
    return plan


def _take_levels(rows: DataFrame, plan: Plan, columns: dict[str, Column], most: int) -> None:
    """The distinct texts of each expression, in text order: with at most ``most`` of them on the driver, else numbered in a table.

    The driver holds counts, and ``most`` texts a column. Numbers are places in ranges of texts plus the sizes of the ranges before, so no task holds a column's.
    """
    names = list(columns)
    cells = F.explode(F.array(*[F.struct(F.lit(k).alias("pos"), c.alias("level")) for k, c in enumerate(columns.values())])).alias("x")
    found = materialise(rows.select(cells).select("x.*").distinct(), "levels")
    sizes = dict(found.groupBy("pos").count().collect())  # a row for each column
    few = [k for k in range(len(names)) if sizes.get(k, 0) <= most]
    plan.levels = {names[k]: [] for k in few}
    for pos, level in found.where(F.col("pos").isin(few)).orderBy("pos", "level").collect() if few else []:  # ``most`` rows a column
        plan.levels[names[pos]].append(level)
    plan.wide = {names[k]: sizes[k] for k in range(len(names)) if k not in few}
    plan.places = {c: names.index(c) for c in plan.wide}
    if plan.wide:
        many = found.where(~F.col("pos").isin(few)) if few else found
        ranged = materialise(many.repartitionByRange("pos", "level").withColumn("range", F.spark_partition_id()), "level-ranges")
        before = Window.partitionBy("pos").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
        counts = ranged.groupBy("pos", "range").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
        inside = F.row_number().over(Window.partitionBy("pos", "range").orderBy("level")) - 1
        plan.numbers = materialise(ranged.withColumn("inside", inside).join(counts, ["pos", "range"]).select("pos", "level", (F.col("before") + F.col("inside")).alias("number")), "level-numbers")
        drop(ranged)
    drop(found)


def _level(df: DataFrame, name: str, plan: Plan) -> Column:
    """The text of a categorical cell, filled. Integers with missing values are named as doubles, as a table of them would hold."""
    kind = kind_of(df, name)
    gaps = df.schema[name].metadata.get("has_null", False)
    if plan.fill.get(name) is None:
        return F.lit(NONE)
    return label(F.coalesce(F.col(quoted(name)), F.lit(plan.fill[name]).cast(kind)), kind, as_float=gaps and is_numeric(kind))


def marked(df: DataFrame, nulls: dict[str, int]) -> DataFrame:
    """Notes in the schema which columns have missing values."""
    return df.select(*[F.col(quoted(c)).alias(c, metadata={**df.schema[c].metadata, "has_null": nulls.get(c, 0) > 0}) for c in df.columns])


def applied(df: DataFrame, plan: Plan, keep: Sequence[str] = ()) -> DataFrame:
    """The columns in ``keep`` and the features, in the table's order, unscaled.

    A wide column becomes the number of its level in text order, from 0, by a join to the table of levels; a level that the fitted rows lack is null.
    """
    out: list[Column] = [F.col(quoted(c)) for c in keep]
    rows = df
    level, number = (unused(n, df.columns) for n in ("__level", "__number"))
    for k, c in enumerate(plan.wide):
        rows = rows.withColumn(f"{level}{k}", _level(df, c, plan))
    for k, c in enumerate(plan.wide):
        known = plan.names(c).select(F.col("level").alias(f"{level}{k}"), F.col("number").cast("double").alias(f"{number}{k}"))
        rows = rows.join(known, f"{level}{k}", "left")
    place = {c: k for k, c in enumerate(plan.wide)}
    for c, t in plan.types.items():
        if c in plan.wide:
            out.append(F.col(f"{number}{place[c]}").alias(c))
        elif t == CATEGORICAL:
            level = _level(df, c, plan)
            out += [F.when(level == v, 1.0).otherwise(0.0).alias(f"{c}_{v}") for v in plan.levels[c]]
        elif t in (BINARY, NUMERICAL):
            out.append(F.coalesce(_number(df, c, plan.indexed.get(c, ())), F.lit(float(plan.fill[c]))).alias(c))
    if not plan.features:
        out += [_number(df, c).alias(c) for c in plan.types if is_numeric(kind_of(df, c))]
    return rows.select(*out)


def scale_fitted(df: DataFrame, plan: Plan, train: Column) -> Plan:
    """Means and population deviations of the scaled features over the rows that ``train`` marks."""
    if plan.scaled:
        stats = [F.avg(quoted(c)).alias(f"m{k}") for k, c in enumerate(plan.scaled)] + [F.stddev_pop(quoted(c)).alias(f"s{k}") for k, c in enumerate(plan.scaled)]
        row = df.where(train).agg(*stats).first()
        plan.means = {c: row[f"m{k}"] or 0.0 for k, c in enumerate(plan.scaled)}
        plan.deviations = {c: row[f"s{k}"] or 1.0 for k, c in enumerate(plan.scaled)}
    return plan


def scaled(df: DataFrame, plan: Plan) -> DataFrame:
    return df.withColumns({c: (F.col(quoted(c)) - F.lit(plan.means[c])) / F.lit(plan.deviations[c]) for c in plan.scaled}) if plan.scaled else df
