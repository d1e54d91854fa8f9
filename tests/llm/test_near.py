from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from forgeledger.llm import near
from forgeledger.llm.components import components


def shingle_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    """Every pair that shares a shingle, linked from 0.75 on; the smallest reachable id."""
    rows = {d: shingle_set(t) for d, t in rows if d is not None}
    holders = defaultdict(list)
    for d, s in rows.items():
        for x in s:
            holders[x].append(d)
    parent = {d: d for d in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    seen = set()
    for ds in holders.values():
        for i, a in enumerate(ds):
            for b in ds[:i]:
                if (a, b) not in seen:
                    seen.add((a, b))
                    both = len(rows[a] & rows[b])
                    if 100 * both >= 75 * (len(rows[a]) + len(rows[b]) - both):
                        x, y = root(a), root(b)
                        parent[max(x, y)] = min(x, y)
    return sorted(((d, len(s), root(d), root(d) == d) for d, s in rows.items()), key=repr)


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_against_brute_force(awkward, supplied, rows):
    for docs in (awkward, supplied):
        result = near.near_groups(docs.withColumn("component_id", F.lit("clash")))
        assert rows(result.where("doc_id is not null")) == brute(pairs(docs))
        assert result.count() == docs.count()


def test_repeated_rows(awkward, rows):
    twice = near.near_groups(awkward.unionAll(awkward)).where("doc_id is not null")
    assert rows(twice.distinct()) == brute(pairs(awkward))
    assert twice.count() == 2 * awkward.where("doc_id is not null").count()


def test_row_without_id(awkward, rows):
    result = near.near_groups(awkward).where("doc_id is null")
    assert {r[2] for r in rows(result)} == {None}


def test_empty(awkward):
    assert near.near_groups(awkward.limit(0)).count() == 0


@pytest.mark.parametrize("block", [2, 5])
def test_long_lists_are_dealt_out(llm, awkward, rows, monkeypatch, block):
    monkeypatch.setattr(near, "BLOCK", block)
    assert rows(near.near_groups(awkward).where("doc_id is not null")) == brute(pairs(awkward))


def test_components_of_paths_and_cycles(llm, rows):
    links = [(i, i + 1) for i in range(50)] + [(60, 61), (61, 62), (62, 60), (70, 70), (99, 80), (99, 81)]
    found = components(llm.createDataFrame(links, "x bigint, y bigint"))
    expected = [(i, 0) for i in range(51)] + [(60, 60), (61, 60), (62, 60), (80, 80), (81, 80), (99, 80)]
    assert rows(found) == sorted(expected, key=repr)
    assert rows(components(llm.createDataFrame([], "x bigint, y bigint"))) == []
