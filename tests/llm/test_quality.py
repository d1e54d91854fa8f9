import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from forgeledger.llm import quality

FOLDER = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def data(llm):
    return llm.read.parquet(f"{FOLDER}/documents.parquet"), llm.read.parquet(f"{FOLDER}/labels.parquet")


@pytest.fixture(scope="module")
def weights(data):
    return quality.fit(*data)


def test_held_out_accuracy(data, weights):
    docs, labels = data
    found = quality.score(docs, weights).where("held_out").join(labels, "doc_id").collect()
    assert len(found) > 300
    right = sum(r.predicted == r.quality for r in found) / len(found)
    good = [r.predicted for r in found if r.quality == 1]
    bad = [r.predicted for r in found if r.quality == 0]
    assert right > 0.97 and np.mean(good) > 0.97 and np.mean(bad) < 0.1, (right, np.mean(good), np.mean(bad))


def test_held_out_rows_teach_nothing(llm, supplied):
    ids = [r.doc_id for r in supplied.select("doc_id").collect()]
    rows = [(i, i % 2) for i in ids]
    labels = llm.createDataFrame(rows, "doc_id bigint, quality int")
    flipped = llm.createDataFrame([(i, 1 - q if zlib.crc32(str(i).encode()) % 4 == 2 else q) for i, q in rows], "doc_id bigint, quality int")
    assert np.allclose(quality.fit(supplied, labels), quality.fit(supplied, flipped), atol=1e-6)


def test_scores_follow_the_definition(supplied, weights):
    docs = supplied.collect()
    found = {r.doc_id: r for r in quality.score(supplied, weights).collect()}
    for doc in docs:
        (places, values), *_ = quality.features(pa.array([doc.text]))
        score = 1 / (1 + np.exp(-float(weights[places] @ values)))
        r = found[doc.doc_id]
        assert r.held_out == (zlib.crc32(str(doc.doc_id).encode()) % 4 == 2)
        assert abs(r.score - score) < 1e-9 and r.predicted == int(r.score >= 0.7)
    assert len(found) == len(docs)


def test_one_update_by_hand():
    leader = quality.Leader()
    leader.learn(np.array([3, 5]), np.array([1.0, 2.0]), 1)
    # The first gradient is -0.5 of each value; the weights were zero.
    assert leader.z[3] == -0.5 and leader.z[5] == -1.0 and leader.n[5] == 1.0
    assert np.allclose(leader.weights(np.array([5])), 1.0 / ((1 + 1) / quality.ALPHA + quality.L2))


def test_awkward_rows(llm, awkward, weights, rows):
    found = quality.score(awkward.withColumns({"score": F.lit(1), "quality": F.lit(2)}), weights)
    assert found.count() == awkward.count()
    assert all(0 <= r.score <= 1 and r.held_out is not None for r in found.collect())
    empty = {round(r.score, 9) for r in quality.score(awkward.where("trim(text) = ''"), weights).collect()}
    assert len(empty) == 1
    assert quality.score(awkward.limit(0), weights).count() == 0
    labels = llm.createDataFrame([(None, 1), (1, None), (7, 1), (7, 0), (7, 1)], "doc_id bigint, quality int")
    assert quality.fit(awkward, labels).shape == weights.shape
    nothing = quality.fit(awkward, labels.limit(0))
    assert {r.score for r in quality.score(awkward, nothing).collect()} == {0.5}


def test_accepted_keeps_whole_rows(supplied, weights, rows):
    expected = [r.doc_id for r in quality.score(supplied, weights).where("predicted = 1").collect()]
    found = quality.accepted(supplied, weights)
    assert found.schema == supplied.schema
    assert rows(found) == rows(supplied.where(F.col("doc_id").isin(expected)))
