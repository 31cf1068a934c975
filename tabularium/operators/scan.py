"""Matches a table's headers with a registry of any size: models are rows, and no pair of headers is looked at that cannot be similar enough.

1. Weights of n-grams are those of ``match``: each model's corpus is its own headers and the table's. The table's side is not repeated for each model: a
   header's length under a model is its length without that model, from three sums, put right for the grams that the model shares.
2. Of a model's header only the rarest grams are looked up, as many as leave less weight behind than the threshold, for what is left cannot reach it alone.
   The candidates are compared exactly.
3. Headers are assigned in rounds: one that is first in turn for the header it likes best takes it, as nobody before it can want that header. Every
   model's first header in turn is done in each round, and mostly many are; the result is that of ``match.assign``, which takes them one after the other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabularium.functions.storage import drop, materialise
from tabularium.operators.match import THRESHOLD, ngrams, normalised


def required(models: DataFrame) -> DataFrame:
    """(model, r, header): the headers of ``models`` (model, headers, output) without the outputs, numbered from 0."""
    kept = F.filter("headers", lambda h: ~h.eqNullSafe(F.col("output")))
    return models.select("model", F.posexplode(kept).alias("r", "header"))


def _grams(df: DataFrame, *keys: str) -> DataFrame:
    grams = df.select(*keys, F.explode(ngrams(normalised(F.col("header")))).alias("gram"))
    return grams.groupBy(*keys, "gram").agg(F.count(F.lit(1)).alias("tf"))


def similar(headers: DataFrame, wanted: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(model, r, u, sim) of the pairs above the threshold, at 12 digits. ``headers`` has u and header, ``wanted`` model, r and header."""
    n_user = headers.count()
    mine = _grams(headers, "u")
    known = mine.groupBy("gram").agg(F.count(F.lit(1)).alias("df_u"))
    size = wanted.groupBy("model").agg((F.count(F.lit(1)) + 1 + n_user).alias("n1"))
    theirs = _grams(wanted, "model", "r").withColumn("df_r", F.count(F.lit(1)).over(Window.partitionBy("model", "gram")))
    theirs = theirs.join(known, "gram", "left").join(size, "model").withColumn("df_u", F.coalesce("df_u", F.lit(0)))
    idf: Column = F.log(F.col("n1") / (1 + F.col("df_u") + F.col("df_r"))) + 1
    theirs = theirs.withColumn("idf", idf)
    own = Window.partitionBy("model", "r")
    raw = F.col("tf") * F.col("idf")
    theirs = theirs.withColumn("w", raw / F.sqrt(F.sum(raw * raw).over(own)))
    before = F.sum(F.col("w") * F.col("w")).over(own.orderBy(F.desc("idf"), "gram").rowsBetween(Window.unboundedPreceding, -1))
    theirs = materialise(theirs.withColumn("left", 1 - F.coalesce(before, F.lit(0.0))), "registry-grams")
    mine = materialise(mine.join(known, "gram"), "header-grams")
    prefix = theirs.where(F.col("left") >= threshold * threshold - 1e-9).select("model", "r", "gram")
    pairs = materialise(prefix.join(mine.select("u", "gram"), "gram").select("model", "r", "u").distinct(), "header-candidates")
    shared = pairs.join(theirs, ["model", "r"]).join(mine.select("u", "gram", F.col("tf").alias("tf_u")), ["u", "gram"])
    dots = shared.groupBy("model", "r", "u").agg(F.sum(F.col("w") * F.col("tf_u") * F.col("idf")).alias("dot"))
    log_u, tf2 = F.log(1 + F.col("df_u")), F.col("tf") * F.col("tf")
    sums = mine.groupBy("u").agg(F.sum(tf2).alias("s0"), F.sum(tf2 * log_u).alias("s1"), F.sum(tf2 * log_u * log_u).alias("s2"))
    top = F.log("n1") + 1
    of_model = theirs.select("model", "gram", "idf", "df_u", "n1").distinct()
    met = pairs.select("model", "u").distinct().join(of_model, "model").join(mine.select("u", "gram", "tf"), ["u", "gram"])
    change = tf2 * (F.col("idf") * F.col("idf") - (top - log_u) * (top - log_u))
    changes = met.groupBy("model", "u").agg(F.sum(change).alias("change"))
    length = F.sqrt(top * top * F.col("s0") - 2 * top * F.col("s1") + F.col("s2") + F.col("change"))
    found = dots.join(changes, ["model", "u"]).join(sums, "u").join(size, "model").select("model", "r", "u", F.round(F.col("dot") / length, 12).alias("sim"))
    return found.where(F.col("sim") > threshold)


def assigned(pairs: DataFrame) -> DataFrame:
    """(model, r, u, sim, place): one header for each that is wanted, in the order in which ``match.assign`` gives them."""
    best = F.max("sim").over(Window.partitionBy("model", "r"))
    left = materialise(pairs.withColumn("turn", F.struct((-best).alias("best"), F.col("r").alias("r"))), "pairs-left")
    rounds = []
    while left.limit(1).count():
        first = F.min("turn").over(Window.partitionBy("model", "u"))
        like = F.min(F.struct((-F.col("sim")).alias("sim"), F.col("u").alias("u"))).over(Window.partitionBy("model", "r"))
        done = left.withColumns({"first": first, "like": like}).where((F.col("first") == F.col("turn")) & (F.col("like.u") == F.col("u")))
        done = materialise(done.select("model", "r", "u", "sim", "turn"), "pairs-done")
        rest = left.join(done.select("model", "r"), ["model", "r"], "left_anti").join(done.select("model", "u"), ["model", "u"], "left_anti")
        before, left = left, materialise(rest.select("model", "r", "u", "sim", "turn"), "pairs-left")
        drop(before)
        rounds.append(done)
    every = left.select("model", "r", "u", "sim", "turn")
    for done in rounds:
        every = every.unionByName(done)
    place = F.row_number().over(Window.partitionBy("model").orderBy("turn")) - 1
    return every.select("model", "r", "u", "sim", place.alias("place"))


def summary(models: DataFrame, found: DataFrame) -> DataFrame:
    """(model, n_required, n_matched, eligible, chosen): chosen is the model of which all headers are matched, the most of them, the first of equals by ``ord``."""
    wanted = models.select("model", "ord", F.size(F.filter("headers", lambda h: ~h.eqNullSafe(F.col("output")))).alias("n_required"))
    counted = wanted.join(found.groupBy("model").agg(F.count(F.lit(1)).alias("n")), "model", "left")
    counted = counted.withColumn("n_matched", F.coalesce("n", F.lit(0)).cast("int")).withColumn("eligible", F.col("n_matched") == F.col("n_required"))
    best = counted.where("eligible").agg(F.min(F.struct((-F.col("n_matched")).alias("n"), "ord", "model")).alias("best")).select(F.col("best.model").alias("__best"))
    return counted.crossJoin(F.broadcast(best)).select("model", "n_required", "n_matched", "eligible", F.coalesce(F.col("model") == F.col("__best"), F.lit(False)).alias("chosen"))


def scanned(headers: DataFrame, models: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(model, place, required, header, score) of what is matched, and ``summary``. ``headers`` has u and header, ``models`` model, ord, headers and output."""
    wanted = required(models)
    found = materialise(assigned(similar(headers, wanted, threshold)), "matched")
    named = found.join(wanted.select("model", "r", F.col("header").alias("required")), ["model", "r"]).join(headers.select("u", "header"), "u")
    return named.select("model", "place", "required", "header", F.round("sim", 3).alias("score")), summary(models, found)
