"""Sharding by balanced label propagation.

Documents are linked through hubs: here a text's digest, so that documents with equal texts are neighbours and no
pair of them is ever a row. Shards start at random. In every round each hub counts its members by shard, and members
ask for the shard that most of their neighbours are in. Requests are granted by gain under the shards' capacities, as
far as there is room, from a rank that is a distributed prefix sum. Rounds end when nothing moves, or when a round leaves no more links inside shards than the one
before, whose places then stay; the number of links inside grows until then, so rounds end. Then shards above their quota hand
over documents to those below: unlinked ones first, then members of the smallest hubs, hub by hub, so that few
links are cut.

The law is ``rows``: the shards' counts differ by one at most.

A hub's counts are aggregated before the shuffle, and joins to a hub with many members are split by adaptive execution.
A round's result is written to the shared folder.

Defined results: a null text is empty, of size 1; null and empty texts are equal. Ids may repeat or be null: rows
count. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabularium.llm.common import drop, materialise, table

SHARDS = 8
#: Room above the mean while documents move; what is too many is handed over at the end, unlinked documents first.
SLACK = 0.25
#: Ranges of a hash that a rank is summed over, for each group and level.
RANGES = 1024
#: Members in a shard up to which a hub is ranked as a whole; larger ones are spread over the ranges.
WHOLE = 64


def _range(*of: Column) -> Column:
    return F.pmod(F.xxhash64(*of), F.lit(RANGES)).cast("int")


def ranked(rows: DataFrame, group: Column, level: Column, within: list[Column], spread: Column) -> DataFrame:
    """Adds ``rank``, from 0, of each row in its group by (level, range of ``spread``, ``within``).

    Groups and levels are few. No task holds a group: rows are numbered in each cell, and the cells' counts are summed up.
    """
    cells = rows.withColumns({"__g": group, "__l": level, "__r": spread})
    counts = cells.groupBy("__g", "__l", "__r").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("__g").orderBy("__l", "__r").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__g", "__l", "__r", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("__before"))
    inside = Window.partitionBy("__g", "__l", "__r").orderBy(*within)
    numbered = cells.join(offsets, ["__g", "__l", "__r"]).withColumn("rank", F.col("__before") + F.row_number().over(inside) - 1)
    return numbered.drop("__g", "__l", "__r", "__before")


def _lookup(key: Column, values: list[int]) -> Column:
    return F.element_at(F.array(*[F.lit(v).cast("long") for v in values]), key + 1)


def _loads(nodes: DataFrame, shards: int) -> list[int]:
    found = dict(nodes.groupBy("shard").count().collect())  # a row for each shard
    return [found.get(s, 0) for s in range(shards)]


def _inside(nodes: DataFrame) -> int:
    """Ordered pairs of linked documents that are in one shard."""
    counts = nodes.where("hub is not null").groupBy("hub", "shard").agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.coalesce(F.sum((F.col("n") * (F.col("n") - 1)).cast("decimal(38,0)")), F.lit(0))).first()[0]


def propagate(nodes: DataFrame, shards: int = SHARDS, slack: float = SLACK) -> DataFrame:
    """``nodes`` has row and hub, the latter null for a document without neighbours; adds ``shard``.

    ``row`` is unique. Counts of the shards differ by one at most.
    """
    now = materialise(nodes.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int")), "shards")
    loads = _loads(now, shards)
    total = sum(loads)
    room = int(total / shards * (1 + slack)) + 1
    inside = _inside(now)
    while True:
        counts = now.where("hub is not null").groupBy("hub", "shard").agg(F.count(F.lit(1)).alias("n"))
        wish = F.max(F.struct("n", F.pmod(F.xxhash64("hub", "shard"), F.lit(1 << 20)).alias("tie"), "shard"))
        wishes = materialise(counts.groupBy("hub").agg(wish.alias("best"), F.sum("n").alias("members")).where("members > best.n").select("hub", F.col("best.shard").alias("wish"), F.col("best.n").alias("there")), "wishes")
        asked = now.join(wishes, "hub").where("shard != wish").select("row", "wish", "there")
        gain = -F.floor(F.log2(F.col("there") + F.lit(1))).cast("int")
        granted = ranked(asked, F.col("wish"), gain, [F.col("row")], _range(F.col("row")))
        free = [max(0, room - n) for n in loads]
        moves = granted.where(F.col("rank") < _lookup(F.col("wish"), free)).select("row", "wish")
        moved = now.join(moves, "row", "left").withColumn("shard", F.coalesce("wish", "shard")).drop("wish")
        moved = materialise(moved, "shards")
        drop(wishes)
        before, inside = inside, _inside(moved)
        if inside <= before:
            drop(moved)
            break
        drop(now)
        now = moved
        loads = _loads(now, shards)
    return _level(now, loads, shards)


def _level(now: DataFrame, loads: list[int], shards: int) -> DataFrame:
    """Hands documents from shards above their quota to those below."""
    total = sum(loads)
    by_load = sorted(range(shards), key=lambda s: -loads[s])  # the fullest shards take the odd rows
    quota = [total // shards] * shards
    for s in by_load[: total % shards]:
        quota[s] += 1
    above = [max(0, n - q) for n, q in zip(loads, quota)]
    below = [max(0, q - n) for n, q in zip(loads, quota)]
    if not sum(above):
        return now
    members = now.where("hub is not null").groupBy("hub", "shard").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    sized = now.join(materialise(members, "members"), ["hub", "shard"], "left")
    level = F.coalesce(F.floor(F.log2("n")), F.lit(0)).cast("int")
    by_hub = F.col("hub").isNotNull() & (F.coalesce(F.col("n"), F.lit(1)) <= WHOLE)
    spread = _range(F.when(by_hub, F.xxhash64("hub")).otherwise(F.xxhash64("row")))
    order = ranked(sized, F.col("shard"), level, [F.col("hub").asc_nulls_first(), F.col("row")], spread)
    first = [sum(above[:s]) for s in range(shards)]
    place = F.col("rank") + _lookup(F.col("shard"), first)
    target, upto = F.lit(None).cast("int"), 0
    for s in range(shards):
        target = F.when((place >= upto) & (place < upto + below[s]), F.lit(s)).otherwise(target)
        upto += below[s]
    leaves = F.col("rank") < _lookup(F.col("shard"), above)
    return order.withColumn("shard", F.when(leaves, target).otherwise(F.col("shard"))).drop("rank", "n")


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS) -> DataFrame:
    """(row, id, size, text_crc32, hub, shard, n_links, n_cut, slot) of each row: its neighbours, and those of them in other shards."""
    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    columns = [F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.sha2(raw, 256).alias("digest")]
    rows = materialise(docs.select(*columns), "shard-rows")
    linked = materialise(rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", F.col("digest").alias("hub")), "hubs")
    placed = materialise(propagate(rows.join(linked, "digest", "left").drop("digest"), shards), "placed")
    drop(rows, linked)
    counted = materialise(_with_links(placed), "counted")
    drop(placed)
    slots = ranked(counted, F.col("shard"), F.lit(0), [F.col("row")], _range(F.col("row")))
    return slots.withColumnRenamed("rank", "slot")


def _with_links(placed: DataFrame) -> DataFrame:
    """Adds n_links and n_cut, from counts by hub and shard."""
    zero = F.lit(0).cast("long")
    together = placed.where("hub is not null")
    here = together.groupBy("hub", "shard").agg(F.count(F.lit(1)).alias("__here"))
    counts = materialise(here.join(together.groupBy("hub").agg(F.count(F.lit(1)).alias("__all")), "hub"), "shard-links")  # a join to an aggregate could not be split
    linked = together.join(counts, ["hub", "shard"]).withColumns({"n_links": F.col("__all") - 1, "n_cut": F.col("__all") - F.col("__here")}).drop("__all", "__here")
    return linked.unionByName(placed.where("hub is null").withColumns({"n_links": zero, "n_cut": zero}))


def cut_links(sharded: DataFrame) -> DataFrame:
    """(links, cut): pairs of documents of a hub, and those in different shards, from counts alone."""
    by_shard = sharded.where("hub is not null").groupBy("hub", "shard").agg(F.count(F.lit(1)).alias("n"))
    pairs = lambda n: n * (n - 1) / 2
    by_hub = by_shard.groupBy("hub").agg(F.sum("n").alias("n"), F.sum(pairs(F.col("n"))).alias("inside"))
    return by_hub.agg(F.coalesce(F.sum(pairs(F.col("n"))), F.lit(0.0)).alias("links"), F.coalesce(F.sum(pairs(F.col("n")) - F.col("inside")), F.lit(0.0)).alias("cut"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard(table(spark, sf_dir, "documents"))
    return placed.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "n_links", "n_cut")
