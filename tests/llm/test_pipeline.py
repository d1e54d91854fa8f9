"""The pipeline's stages against what each one's own brute force says of its input."""

import hashlib
import inspect
from collections import defaultdict

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as P
from test_decontaminate import brute as leaked
from test_exact import brute as equal
from test_exact import fold
from test_near import brute as alike
from test_packing import check

FOLDER = "/root/testdata/sf0.001"


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_stages_on_supplied_documents(llm, supplied, tmp_path):
    names = [n for n, _ in P.STAGES]
    assert names == ["quality", "exact_dedup", "near_dedup", "decontamination", "packing"]
    assert all(list(inspect.signature(f).parameters) == ["spark", "docs", "sf_dir"] for _, f in P.STAGES)
    items = [(r.item_id, r.text) for r in llm.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    docs, ids = supplied, []
    for name, stage in P.STAGES:
        before = pairs(docs)
        made = stage(llm, docs, FOLDER)
        made.write.parquet(f"{tmp_path}/{name}")
        docs = llm.read.parquet(f"{tmp_path}/{name}")
        if name == "packing":
            check(docs.collect(), before, Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")))
            break
        assert docs.columns == supplied.columns
        ids = sorted(r[0] for r in pairs(docs))
        if name == "exact_dedup":
            assert ids == sorted(r[0] for r in equal(before) if r[3])
        if name == "near_dedup":
            assert ids == sorted(r[0] for r in alike(before) if r[3])
        if name == "decontamination":
            assert ids == sorted({d for d, _ in before} - {r[0] for r in leaked(before, items)})
        if name == "quality":
            labels = {r.doc_id: r.quality for r in llm.read.parquet(f"{FOLDER}/labels.parquet").collect()}
            good = [d for d, _ in before if labels.get(d) == 1]
            assert len(set(good) & set(ids)) >= 0.9 * len(good)


def test_awkward_rows_and_extra_columns(llm, awkward):
    docs = awkward.withColumns({"kept": F.lit(1), "kept_doc_id": F.lit(2), "score": F.lit(3)})
    for name, stage in P.STAGES[:-1]:
        made = stage(llm, docs, FOLDER)
        assert made.columns == docs.columns, name
        assert made.count() <= docs.count()
    assert P.exact_stage(llm, docs.limit(0), FOLDER).count() == 0
    assert P.near_stage(llm, docs.limit(0), FOLDER).count() == 0


def firsts(numbered, label, before=lambda text: 0):
    """One (id, text) of each group of rows with equal labels."""
    groups = defaultdict(list)
    for n, (i, t) in enumerate(numbered):
        digest = "" if t is None else hashlib.sha256(t.encode()).hexdigest()
        groups[label(n, i, t)].append((before(t), i is None, i or 0, digest, n))
    return sorted((numbered[min(g)[-1]] for g in groups.values()), key=repr)


def test_repeated_rows_and_missing_ids_leave_one_row_a_group(llm, rows):
    base = [f"w{i}" for i in range(60)]
    one, near, other = " ".join(base), " ".join([*base[:-1], "end"]), " ".join(f"v{i}" for i in range(60))
    held = [
        (1, one), (1, one), (2, one), (None, one), (None, one), (None, one + " "), (3, near), (3, near), (None, near),
        (None, other), (None, other), (None, "no id"), (None, "noid"), (4, "no  id"), (4, "n oid "), (5, ""), (5, ""), (6, None), (None, None),
        (None, ""), (None, " "), (7, one.upper()), (3, other), (8, "five words and one more"), (8, "five words and one more"),
    ]
    docs = llm.createDataFrame([(*r, n) for n, r in enumerate(held)], "doc_id bigint, text string, score bigint").repartition(3)
    exact = P.exact_stage(llm, docs, FOLDER)
    assert rows(exact, "doc_id", "text") == firsts(held, lambda n, i, t: fold(t), lambda t: -len(t or ""))
    component = {r[0]: r[2] for r in alike([(n, t) for n, (_, t) in enumerate(held)])}
    near_copies = P.near_stage(llm, docs, FOLDER)
    assert rows(near_copies, "doc_id", "text") == firsts(held, lambda n, i, t: component[n] if (t or "").split() else (i, t))
    assert exact.columns == near_copies.columns == docs.columns


def test_run(llm):
    assert P.run(llm, FOLDER).count() > 50
