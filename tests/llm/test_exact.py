import hashlib
import re
import uuid
from collections import defaultdict

from pyspark.sql import functions as F

from forgeledger.llm.exact import DigestIndex, deduplicate


def fold(text):
    return re.sub("[\x20\x09-\x0d]+", "", text or "")


def brute(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[fold(text)].append((-len(text or ""), doc_id is None, doc_id or 0, doc_id))
    out = []
    for doc_id, text in rows:
        group = groups[fold(text)]
        keep = min(group)[3]
        out.append((doc_id, keep, len(group), doc_id == keep, hashlib.sha256(fold(text).encode()).hexdigest()))
    return sorted(out, key=repr)


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_against_brute_force(llm, awkward, supplied, rows):
    for docs in (awkward, supplied):
        assert rows(deduplicate(docs)) == brute(pairs(docs))


def test_empty_and_clashing_columns(llm, awkward, rows):
    assert deduplicate(awkward.limit(0)).count() == 0
    extra = awkward.withColumns({n: F.lit(1) for n in ("digest", "keep_id", "kept", "group_size", "best")})
    assert rows(deduplicate(extra)) == brute(pairs(awkward))


def test_later_batches_meet_the_index(llm, tmp_path, rows):
    path = f"file://{tmp_path}/{uuid.uuid4().hex}"
    first = llm.createDataFrame([(1, "a b"), (2, "ab  "), (3, "c")], "doc_id bigint, text string")
    second = llm.createDataFrame([(4, "a\nb"), (5, "d"), (0, "c c")], "doc_id bigint, text string")
    index = DigestIndex(llm, path, buckets=3)
    assert rows(index.add(first), "doc_id", "keep_id", "kept") == [(1, 2, False), (2, 2, True), (3, 3, True)]
    again = DigestIndex(llm, path, buckets=3)
    assert rows(again.add(second), "doc_id", "keep_id", "kept") == [(0, 0, True), (4, 2, False), (5, 5, True)]
    # A batch that is run again adds nothing.
    assert rows(again.add(second), "doc_id", "keep_id", "kept") == [(0, 0, True), (4, 2, False), (5, 5, True)]
    assert again.rows().count() == 4


def test_index_is_not_shuffled_or_python(llm):
    index = DigestIndex(llm, f"file:///tmp/forgeledger-test-{uuid.uuid4().hex}", buckets=4)
    frame = llm.range(9).select(F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("digest"))
    plan = frame.repartition(4, "digest").join(index.rows().hint("merge"), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "SortMergeJoin" in plan and "Python" not in plan
