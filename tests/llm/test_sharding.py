import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tabularium.llm import sharding


def stored(spark, tmp_path, rows):
    spark.createDataFrame(rows, "doc_id long, text string, shard int").repartition(3).write.parquet(str(tmp_path / "t"))
    return spark.read.parquet(str(tmp_path / "t"))


def test_law_slots_and_links(spark, tmp_path):
    rows = [(k, f"own {k}", 0) for k in range(300)] + [(1000 + k, f"group {k % 40}", 0) for k in range(200)] + [(None, None, 0), (None, "", 0), (7, "own 7", 0)]
    placed = sharding.shard(stored(spark, tmp_path, rows))
    out = placed.collect()
    assert len(out) == len(rows)
    counts = Counter(r.shard for r in out)
    assert set(counts) <= set(range(8)) and max(counts.values()) - min(counts.values()) <= 1
    for s in counts:
        assert sorted(r.slot for r in out if r.shard == s) == list(range(counts[s]))
    text = {k: t for k, t, _ in rows}
    for r in out:
        raw = (text[r.id] or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 1, zlib.crc32(raw))
    groups = defaultdict(set)
    for r in out:
        groups[r.text_crc32].add(r.shard)
    assert sum(len(s) > 1 for s in groups.values()) <= 7
    links, cut = sharding.cut_links(placed).first()
    assert links == 40 * 10 + 1 + 1 and cut <= 0.2 * links


def test_a_group_larger_than_a_shard(spark, tmp_path):
    rows = [(k, "same", 0) for k in range(400)] + [(1000 + k, f"own {k}", 0) for k in range(41)]
    out = sharding.shard(stored(spark, tmp_path, rows)).collect()
    counts = Counter(r.shard for r in out)
    assert len(out) == 441 and max(counts.values()) - min(counts.values()) <= 1


def test_few_rows_and_none(spark, tmp_path):
    out = sharding.shard(stored(spark, tmp_path / "a", [(1, "a", 0), (2, "a", 0), (3, "a", 0)])).collect()
    assert len(out) == 3 and max(Counter(r.shard for r in out).values()) == 1 and {r.slot for r in out} == {0}
    assert sharding.shard(stored(spark, tmp_path / "b", [])).count() == 0


def brute(spark, hubs, shards, slack):
    """The shard of each row, by the same rules over dictionaries; ``hubs`` has the hub or None of each row 0, 1, ..."""
    import math

    h = lambda df: {tuple(r)[:-1]: r[-1] for r in df.collect()}
    n = len(hubs)
    of_row = h(spark.range(n).select("id", F.xxhash64("id")))
    names = sorted({x for x in hubs if x is not None})
    pairs = spark.createDataFrame([(x, s) for x in names for s in range(shards)] or [("", 0)], "hub string, shard int")
    tie = {k: v % (1 << 20) for k, v in h(pairs.select("hub", "shard", F.xxhash64("hub", "shard"))).items()}
    of_hub = h(pairs.select("hub", F.xxhash64("hub")).distinct())
    spread_hub = h(spark.createDataFrame([(x, v) for (x,), v in of_hub.items()], "hub string, v long").select("hub", F.xxhash64("v")))
    spread_row = h(spark.createDataFrame([(r, v) for (r,), v in of_row.items()], "id long, v long").select("id", F.xxhash64("v")))
    shard = [of_row[(r,)] % shards for r in range(n)]
    room = int(n / shards * (1 + slack)) + 1
    inside = lambda: sum(n * (n - 1) for n in Counter((hubs[r], shard[r]) for r in range(n) if hubs[r] is not None).values())
    while True:
        best, before = inside(), list(shard)
        count = Counter((hubs[r], shard[r]) for r in range(n) if hubs[r] is not None)
        loads = Counter(shard)
        asked = defaultdict(list)
        for r in range(n):
            if hubs[r] is None:
                continue
            there, _, wish = max((count[hubs[r], s], tie[hubs[r], s], s) for s in range(shards) if count[hubs[r], s])
            if shard[r] != wish:
                asked[wish].append((-math.floor(math.log2(there + 1)), of_row[(r,)] % sharding.RANGES, r))
        moves = [(r, s) for s, rows in asked.items() for _, _, r in sorted(rows)[: max(0, room - loads[s])]]
        for r, s in moves:
            shard[r] = s
        if inside() <= best:
            shard = before
            break
    loads = Counter(shard)
    by_load = sorted(range(shards), key=lambda s: -loads[s])
    quota = {s: n // shards + (k < n % shards) for k, s in enumerate(by_load)}
    count = Counter((hubs[r], shard[r]) for r in range(n) if hubs[r] is not None)
    leaving = []
    for s in range(shards):
        rows = []
        for r in range(n):
            if shard[r] == s:
                m = count.get((hubs[r], s), 0) if hubs[r] is not None else 0
                level = math.floor(math.log2(m)) if m > 1 else 0
                whole = hubs[r] is not None and m <= sharding.WHOLE
                rows.append((level, (spread_hub[(hubs[r],)] if whole else spread_row[(r,)]) % sharding.RANGES, hubs[r] is not None, hubs[r] or "", r))
        leaving += [x[-1] for x in sorted(rows)[: max(0, loads[s] - quota[s])]]
    free = [s for s in range(shards) for _ in range(max(0, quota[s] - loads[s]))]
    for r, s in zip(leaving, free):
        shard[r] = s
    return shard


def test_propagation_as_by_brute_force(spark):
    for groups, alone, shards in ((12, 30, 3), (3, 10, 4), (0, 9, 2)):
        hubs = [f"h{k % groups}" for k in range(groups * 7)] + [None] * alone
        nodes = spark.createDataFrame([(r, x) for r, x in enumerate(hubs)], "row long, hub string")
        found = {r.row: r.shard for r in sharding.propagate(nodes, shards=shards).collect()}
        assert [found[r] for r in range(len(hubs))] == brute(spark, hubs, shards, sharding.SLACK)


def test_fewer_links_are_cut_than_at_random(spark, tmp_path):
    rows = [(k, f"group {k % 50}", 0) for k in range(400)] + [(1000 + k, f"own {k}", 0) for k in range(400)]
    placed = sharding.shard(stored(spark, tmp_path, rows))
    links, cut = sharding.cut_links(placed).first()
    _, at_random = sharding.cut_links(placed.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(8)))).first()
    assert links == 50 * 28 and cut < 0.1 * at_random
    rows = placed.collect()
    assert (sum(r.n_links for r in rows), sum(r.n_cut for r in rows)) == (2 * links, 2 * cut)
