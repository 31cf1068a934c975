import hashlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from tabularium.llm import bpe, mixing, toxicity

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs.toPandas()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = corpus_pipeline.materialise(stage(spark, docs, SF), f"stage{k}")
        out.append(path.toPandas())
        docs = path
    return out


def test_columns(stages):
    assert all(list(s.columns) == list(stages[0].columns) for s in stages[:-1])


def test_toxic_documents_go(spark, stages):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    scored = toxicity.score(docs, toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))).collect()
    assert sorted(stages[1].doc_id) == sorted(r.doc_id for r in scored if r.p_toxic < toxicity.THRESHOLD)
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas().set_index("doc_id").toxic
    gone = set(stages[0].doc_id) - set(stages[1].doc_id)
    assert all(labels.get(k, 1) == 1 for k in gone)


def test_one_of_equal_texts_stays(stages):
    best = {}
    for r in stages[1].itertuples():
        bare = "".join(r.text.split(" ")).translate({ord(c): None for c in "\t\n\x0b\x0c\r"})
        best[bare] = min(best.get(bare, (1, 0)), (-len(r.text), r.doc_id))
    assert sorted(stages[2].doc_id) == sorted(k for _, k in best.values())


def test_one_of_near_copies_stays(stages):
    from test_jaccard_join import brute

    rows = list(zip(stages[2].doc_id.tolist(), stages[2].text.tolist()))
    assert sorted(stages[3].doc_id) == sorted({c for _, c, _ in brute(rows)})


def test_mixture(spark, stages):
    taken = mixing.mix(spark.createDataFrame(stages[3])).collect()
    want = Counter({r.id: -(-r.taken // r.size) for r in taken if r.taken})
    assert Counter(stages[4].doc_id) == want


def test_tokens(stages):
    own = bpe.Encoder(bpe.default_vocabulary())
    text = dict(zip(stages[4].doc_id, stages[4].text))
    assert Counter(stages[5].doc_id) == Counter(stages[4].doc_id)
    for r in stages[5].itertuples():
        ids = np.array(own.full.encode(text[r.doc_id], add_special_tokens=False).ids, "<u4").tobytes()
        assert bytes(r.ids) == ids and r.ids_sha256 == hashlib.sha256(ids).hexdigest() and r.n_tokens == len(ids) // 4
        assert r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()


def test_run_is_the_stages_in_order(spark, stages):
    got = corpus_pipeline.run(spark, SF).select("doc_id", "ids_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(zip(stages[5].doc_id, stages[5].ids_sha256))
