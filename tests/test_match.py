import random

import pytest

from tabularium.operators import match, scan
from tabularium.sources.registry import Model, Registry, image_matches
from tabularium.sources.synthetic import COLUMNS

HEADERS = [*COLUMNS, "anxiety"]


def test_cohort(spark):
    found = match.match(spark, HEADERS)
    assert {m: (x.n_matched, x.n_required, x.eligible) for m, x in found.per_model.items()} == {"MODEL_01": (21, 21, True), "MODEL_02": (8, 8, True), "MODEL_03": (2, 12, False)}
    assert found.chosen == "MODEL_01" and found.target == "anxiety" and len(found.valid_headers) == 21
    assert found.per_model["MODEL_03"].matched == {"age": ("age", 1.0), "sex": ("gender", 1.0)}


def test_synonyms(spark):
    wanted = Registry([Model("M", "table", "m", "t", ("gender", "age", "assistance_adl"), "y")])
    found = match.match(spark, ["Sex", "patient-age", "ADL", "dob"], wanted)
    assert found.per_model["M"].matched == {"gender": ("Sex", 1.0), "age": ("dob", 1.0), "assistance_adl": ("ADL", 0.803)}


def test_best_similarities(spark):
    from tabularium.plans.oracles import ORDER_HEADERS

    model = Model("O", "table", "o", "t", ORDER_HEADERS, "y")
    rows = match.similarities(match.corpus(spark, ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"], [model])).collect()
    best = [max(r.sim for r in rows if r.req_idx == k) for k in range(6)]
    assert [round(x, 3) for x in best] == [0.523, 0.457, 0.7, 0.73, 0.643, 0.778]


def test_assignment_is_one_to_one_and_above():
    matrix = [[0.9, 0.8], [0.95, 0.1], [0.6, 0.6]]
    assert match.assign(matrix, 0.6) == [(1, 0, 0.95), (0, 1, 0.8)]
    assert match.assign([[0.7, 0.7]], 0.6) == [(0, 0, 0.7)]
    assert match.assign([[0.6]], 0.6) == []


def test_no_match_keeps_the_forced_target(spark):
    found = match.match(spark, ["zzz"], target="zzz")
    assert found.chosen is None and found.valid_headers == [] and found.target == "zzz"
    with pytest.raises(ValueError):
        match.match(spark, [])


def test_embedder(spark):
    found = match.match(spark, ["b", "a"], Registry([Model("M", "table", "m", "t", ("a", "b", "y"), "y")]), embedder=lambda hs: [[h == "a", h == "b"] for h in hs])
    assert found.per_model["M"].matched == {"a": ("a", 1.0), "b": ("b", 1.0)}
    assert found.valid_headers == ["a", "b"]


def test_registry(spark):
    registry = Registry()
    registry.register(Model("MODEL_99", "image", "chest x-ray", "detection"))
    frame = registry.frame(spark)
    assert registry.modalities() == ["breast histopathology scan", "chest x-ray", "colon colonoscopy scan"]
    got = image_matches(frame, spark.createDataFrame([("colon colonoscopy scan",), ("none",), ("chest x-ray",)], "modality string"))
    assert dict(map(tuple, got.collect())) == {"colon colonoscopy scan": "MODEL_06", "none": None, "chest x-ray": "MODEL_99"}


def same_as_one_by_one(spark, headers, models):
    """The distributed scan gives the matches of ``match.match`` and its choice."""
    registry = Registry(models)
    want = match.match(spark, headers, registry)
    rows = spark.createDataFrame(list(enumerate(headers)), "u int, header string")
    found, counts = scan.scanned(rows, registry.frame(spark).where("kind = 'table'"))
    got = {}
    for r in found.orderBy("model", "place").collect():
        got.setdefault(r.model, {})[r.required] = (r.header, r.score)
    assert got == {m: x.matched for m, x in want.per_model.items() if x.matched}
    assert all(list(got[m]) == list(want.per_model[m].matched) for m in got)
    summary = {r.model: r for r in counts.collect()}
    assert {m: (r.n_required, r.n_matched, r.eligible) for m, r in summary.items()} == {m: (x.n_required, x.n_matched, x.eligible) for m, x in want.per_model.items()}
    assert [m for m, r in summary.items() if r.chosen] == ([want.chosen] if want.chosen else [])
    return got


def test_scan_of_the_cohort_and_of_all_given_tables(spark):
    assert same_as_one_by_one(spark, HEADERS, Registry().models)["MODEL_03"] == {"age": ("age", 1.0), "sex": ("gender", 1.0)}
    tables = {t: spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").columns for t in ("orders", "lineitem", "customer", "part", "supplier", "nation", "events", "documents", "conversations")}
    models = [Model(t, "table", t, "t", tuple(x.split("_", 1)[-1] for x in c), c[0]) for t, c in tables.items()]
    assert len(same_as_one_by_one(spark, [c for own in tables.values() for c in own], models)) > 4


def test_scan_of_many_similar_headers(spark):
    """Headers that want the same ones, equal headers, and none that match."""
    rng = random.Random(4)
    words = ["blood", "pressure", "rate", "heart", "mean", "max", "level", "score"]
    headers = ["_".join(rng.choices(words, k=rng.choice([1, 2, 3]))) for _ in range(40)] + ["score", "score"]
    models = [Model(f"M{m}", "table", "m", "t", tuple(dict.fromkeys("_".join(rng.choices(words, k=rng.choice([1, 2, 3]))) for _ in range(12))), "none") for m in range(6)]
    same_as_one_by_one(spark, headers, [*models, Model("NONE", "table", "m", "t", ("zzzz", "qqqq"), "y"), Model("ONE", "table", "m", "t", ("score", "y"), "y")])


def test_rounds_give_the_assignment_of_turns(spark):
    rng = random.Random(9)
    for size in (1, 6, 12):
        matrix = [[rng.choice([0.0, 0.61, 0.7, 0.7, 0.9, 1.0]) for _ in range(size)] for _ in range(size)]
        pairs = [("m", r, u, s) for r, row in enumerate(matrix) for u, s in enumerate(row) if s > 0.6]
        found = scan.assigned(spark.createDataFrame(pairs, "model string, r int, u int, sim double")).orderBy("place").collect()
        assert [(x.r, x.u, x.sim) for x in found] == match.assign(matrix, 0.6)
