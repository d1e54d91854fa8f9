import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from forgeledger.llm import ngram_join
from forgeledger.llm.queries import op13_ngram_jaccard_join

SHAPE = "doc_id bigint, text string"


def shingle_set(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute(rows, percent=80):
    """Every pair of rows that share a shingle, linked from ``percent`` on; the smallest reachable id of each row."""
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    seen = set()
    for own in holders.values():
        for n, i in enumerate(own):
            for j in own[:n]:
                if (i, j) not in seen:
                    seen.add((i, j))
                    both = len(sets[i] & sets[j])
                    if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                        parent[root(i)] = root(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[root(i)] += [d] if d is not None else []
    return sorted(((d, len(s), min(least[root(i)], default=None)) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=repr)


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def copies(seed=11, n=140):
    """Near copies of a few texts at all distances around the threshold, and texts around one passage."""
    draw = random.Random(seed)
    word = lambda: "".join(draw.choices("abcdefgh", k=draw.randint(2, 6)))
    bases, passage = [[word() for _ in range(size)] for size in (12, 60, 61, 150)], [word() for _ in range(80)]
    rows = []
    for i in range(n):
        words = list(draw.choice(bases))
        for _ in range(draw.randint(0, max(1, len(words) // 14))):
            words[draw.randrange(len(words))] = word()
        rows.append((1000 + i, " ".join(words)))
    rows += [(2000 + i, " ".join([word() for _ in range(draw.randint(0, 60))] + passage + [word() for _ in range(9)])) for i in range(60)]
    draw.shuffle(rows)
    return rows


def test_against_brute_force(llm, awkward, rows):
    result = ngram_join.linked_groups(awkward.withColumn("component_id", F.lit("clash")).withColumn("cid", F.lit("clash")))
    assert rows(result) == brute(pairs(awkward))


@pytest.mark.parametrize("percent", [60, 80])
def test_near_copies_at_all_distances(llm, rows, percent):
    data = copies()
    docs = llm.createDataFrame(data, SHAPE).repartition(4)
    assert rows(ngram_join.linked_groups(docs, percent)) == brute(data, percent)


@pytest.mark.parametrize("block, loud, shingles", [(2, 1 << 16, 1 << 20), (16, 3, 400)])
def test_long_lists_are_dealt_out(llm, rows, monkeypatch, block, loud, shingles):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "BLOCK_SHINGLES", shingles)
    monkeypatch.setattr(ngram_join, "LOUD", loud)
    data = copies(block)
    assert rows(ngram_join.linked_groups(llm.createDataFrame(data, SHAPE))) == brute(data)


def test_repeated_rows_and_ids(llm, rows):
    text = " ".join(map(str, range(40)))
    data = [(7, text), (7, text.replace("39", "x")), (7, "a b c d e f"), (3, "A b c d e f"), (None, text), (9, text + " 40"), (None, "q")]
    data += data + [(None, text)] * 50
    assert rows(ngram_join.linked_groups(llm.createDataFrame(data, SHAPE))) == brute(data)


def test_empty(awkward):
    assert ngram_join.linked_groups(awkward.limit(0)).count() == 0


def test_query(llm, rows):
    folder = "/root/testdata/sf0.001"
    assert rows(op13_ngram_jaccard_join(llm, folder)) == brute(pairs(llm.read.parquet(f"{folder}/documents.parquet")))


def random_sets(rng, n):
    bases = [np.unique(rng.integers(0, 1 << 63, rng.integers(1, 80), dtype=np.uint64)) for _ in range(rng.integers(1, 8))]
    out = []
    for _ in range(n):
        own = bases[rng.integers(len(bases))].copy()
        at = rng.choice(len(own), min(len(own) - 1, int(rng.integers(0, len(own) // 4 + 2))), replace=False)
        own[at] = rng.integers(0, 1 << 63, len(at), dtype=np.uint64)
        out.append(np.unique(own))
    return out


def classes(n, links, known):
    parent, first = list(range(n)), {}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, k in enumerate(known):
        parent[root(i)] = root(first.setdefault(int(k), i))
    for a, b in links:
        parent[root(a)] = root(b)
    found = defaultdict(list)
    for i in range(n):
        found[root(i)].append(i)
    return sorted(found.values())


@pytest.mark.parametrize("seed", range(30))
def test_trees_find_every_link(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(2, 130))
    members = random_sets(rng, n)
    known = rng.integers(0, n, n) if seed % 2 else np.arange(n)
    side = rng.integers(0, 2, n) if seed % 3 == 0 else np.zeros(n, int)
    similar = []
    for i in range(n):
        for j in range(i):
            both = len(np.intersect1d(members[i], members[j]))
            if 100 * both >= 80 * (len(members[i]) + len(members[j]) - both) and (side[i] != side[j] or side.min() == side.max()):
                similar.append((i, j))
    links = ngram_join.forest(members, known, side)
    assert classes(n, links, known) == classes(n, similar, known)
    assert len(links) < n and {tuple(sorted(x, reverse=True)) for x in links} <= set(similar)


@pytest.mark.parametrize("seed", range(30))
def test_bitmaps_leave_out_no_set_with_a_partner(seed):
    rng = np.random.default_rng(100 + seed)
    n = int(rng.integers(2, 130))
    members = random_sets(rng, n)
    known = rng.integers(0, n, n) if seed % 2 else np.arange(n)
    side = rng.integers(0, 2, n) if seed % 3 == 0 else np.zeros(n, int)
    maps = [ngram_join.bitmaps(m, np.array([0, len(m)]), ngram_join.map_bits(len(m)))[0] for m in members]
    marked = ngram_join.partnered(maps, np.array([len(m) for m in members]), known, side)
    for i in range(n):
        for j in range(i):
            both = len(np.intersect1d(members[i], members[j]))
            if 100 * both >= 80 * (len(members[i]) + len(members[j]) - both) and known[i] != known[j]:
                if side[i] != side[j] or side.min() == side.max():
                    assert marked[i] and marked[j]


def test_runs_of_any_length_are_listed(monkeypatch):
    """Every pair of sets is in a list of its first common shingle, whatever the batches and the bounds."""
    import pyarrow as pa

    rng = np.random.default_rng(7)
    members = random_sets(rng, 60)
    rows = sorted((int(t.view(np.int64)), len(m) << 32 | p, i) for i, m in enumerate(members) for p, t in enumerate(m[: ngram_join.prefix_length(len(m), 80)]))
    similar = set()
    for i in range(60):
        for j in range(i):
            both = len(np.intersect1d(members[i], members[j]))
            if 100 * both >= 80 * (len(members[i]) + len(members[j]) - both):
                similar.add((j, i))
    assert similar
    for longest, short, size in ((1 << 16, 8, 7), (3, 8, 2), (1, 2, 1000), (1 << 16, 3, 50)):
        monkeypatch.setattr(ngram_join, "LONGEST", longest)
        monkeypatch.setattr(ngram_join, "SHORT", short)
        batches = []
        for at in range(0, len(rows), size):
            token, packed, cid = zip(*rows[at : at + size], strict=True)
            salt = pa.array([-1] * len(token), pa.int32())
            batches.append(pa.record_batch({"token": pa.array(token, pa.int64()), "cid": pa.array(cid, pa.int64()), "packed": pa.array(packed, pa.int64()), "salt": salt}))
        lists = defaultdict(set)
        for out in ngram_join._shared(batches, 80):
            for name, n, cid in zip(*(out.column(c).to_pylist() for c in ("list", "n", "cid")), strict=True):
                lists[name, n].add(cid)
        assert all(n is None or n == len(own) for (_, n), own in lists.items())
        assert all(any({i, j} <= own for own in lists.values()) for i, j in similar)


def test_a_node_bounds_what_is_below_it():
    rng = np.random.default_rng(4)
    members = random_sets(rng, 70)
    ends = np.concatenate([[0], np.cumsum([len(m) for m in members])])
    tree = ngram_join.SignatureTree(ngram_join.bitmaps(np.concatenate(members), ends, 256), np.diff(ends), 3)
    for level in range(4):
        for node in range(len(tree.low[level])):
            below = members[node * 8**level : (node + 1) * 8**level]
            assert tree.low[level][node] == min(map(len, below)) and tree.high[level][node] == max(map(len, below))
            other = tree.maps[0][0]
            most = int(np.bitwise_count(tree.maps[level][node] & other).sum()) + min(tree.excess[level][node], tree.excess[0][0])
            assert all(len(np.intersect1d(m, members[0])) <= most for m in below)


def test_prefixes_of_similar_sets_meet():
    for a in range(1, 60):
        for b in range(a, 80):
            least = -(-80 * (a + b) // 180)
            if least <= a:
                # Of sets with the least overlap wanted, what is not in a prefix is fewer than that.
                assert a - ngram_join.prefix_length(a, 80) < least and b - ngram_join.prefix_length(b, 80) < least
