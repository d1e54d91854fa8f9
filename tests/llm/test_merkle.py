import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from forgeledger.llm import merkle

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(*values):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
    return levels


def beside(levels, i):
    """Digests left and right of a leaf's path, level by level."""
    out = []
    for level in levels[:-1]:
        run = i // 8 * 8
        out.append(("".join(level[run:i]), "".join(level[i + 1 : run + 8])))
        i //= 8
    return out


def brute(rows):
    """``doc_id, leaf, subroot, root, proof, folded_root, copied`` of rows ``group, doc_id, leaf, changed``."""
    groups = defaultdict(list)
    for row in rows:
        groups[row[0]].append(row)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for name in names:
        groups[name].sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3] is not None, r[3] or ""))
    trees = {g: tree([r[2] for r in groups[g]]) for g in names}
    upper = tree([trees[g][-1][0] for g in names])
    out = []
    for n, g in enumerate(names):
        for i, (_, doc_id, own, changed) in enumerate(groups[g]):
            way = beside(trees[g], i) + beside(upper, n)
            nodes = [changed or own]
            for left, right in way:
                nodes.append(h(left, nodes[-1], right))
            proof = [a + b for a, b in way]
            out.append((doc_id, own, trees[g][-1][0], upper[-1][0], proof, nodes[-1], nodes if changed else None))
    return sorted(out, key=repr)


def leaves_of(groups, seed=3):
    """Rows of groups of given sizes; a third is tampered with."""
    draw = random.Random(seed)
    rows = []
    for name, n in groups.items():
        for i in range(n):
            own = h(str(draw.random()))
            rows.append((name, draw.randrange(10 * n), own, h(own) if draw.random() < 0.3 else None))
    return rows


SHAPE = "group string, doc_id bigint, leaf string, changed string"


@pytest.mark.parametrize("levels", [1, 2, 3])
def test_against_brute_force(llm, rows, levels):
    data = leaves_of({"en": 600, "fr": 65, "de": 64, "es": 8, "it": 1, None: 9, "": 2, "é": 7, "z": 63, "a": 513})
    data += [("twice", 5, "aa", None), ("twice", 5, "aa", None), ("twice", None, "bb", "cc"), ("twice", 5, "ab", None)]
    frame = llm.createDataFrame(data, SHAPE).withColumn("position", F.lit("clash")).repartition(5)
    assert rows(merkle.manifest(frame, levels)) == brute(data)


@pytest.mark.parametrize("groups", [{"en": 1}, {"en": 2}, {"en": 9}, {None: 1, "a": 1}, {f"{i:03}": 1 + i % 3 for i in range(70)}])
def test_few_leaves_and_many_groups(llm, rows, groups):
    data = leaves_of(groups)
    assert rows(merkle.manifest(llm.createDataFrame(data, SHAPE), 1)) == brute(data)


def test_groups_that_reach_over_many_slices(llm, many_slices, rows):
    data = leaves_of({"en": 300, None: 90, "a": 1, **{f"{i:03}": 2 for i in range(60)}})
    data += [("en", None, f"{i % 7}", None) for i in range(40)] + [("en", 5, "aa", "bb" if i % 2 else None) for i in range(40)]
    assert rows(merkle.manifest(llm.createDataFrame(data, SHAPE).repartition(3))) == brute(data)


def test_empty(llm):
    assert merkle.manifest(llm.createDataFrame([], SHAPE)).count() == 0


def test_leaf_of_awkward_rows(awkward):
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    for row in awkward.select(*columns, merkle.leaf(*map(F.col, columns)).alias("leaf")).collect():
        assert row.leaf == leaf(*row[:5])


def test_a_version_shares_every_node_off_the_path():
    made = merkle.grown([h(str(i)) for i in range(100)], None)
    top, height = made[-1][0], len(made) - 1
    for at in (0, 7, 8, 63, 64, 99):
        new = merkle.with_leaf(top, height, at, "x" * 64)
        changed = [n.digest for n in tree_nodes(new[-1])]
        assert new[-1].digest == tree([h(str(i)) if i != at else "x" * 64 for i in range(100)])[-1][0]
        assert len(new) == height + 1 and {id(n) for n in tree_nodes(new[-1])} - {id(n) for n in tree_nodes(top)} == {id(n) for n in new}
        assert len(changed) == sum(map(len, made))
    # The tree itself is as before.
    assert top.digest == tree([h(str(i)) for i in range(100)])[-1][0]


def tree_nodes(node):
    yield node
    for below in node.below:
        yield from tree_nodes(below)


def test_query(llm, rows):
    from forgeledger.llm.queries import op11_merkle_manifest

    folder = "/root/testdata/sf0.001"
    data = []
    for r in llm.read.parquet(f"{folder}/documents.parquet").collect():
        own = leaf(r.doc_id, r.source, r.lang, r.n_chars, r.text)
        low = leaf(r.doc_id, r.source, r.lang, r.n_chars, r.text and r.text.translate(LOWER))
        data.append((r.lang, r.doc_id, own, low if zlib.crc32(str(r.doc_id).encode()) % 3 == 0 else None))
    expected = [(d, x, s, r, h(*p), f, f == r) for d, x, s, r, p, f, _ in brute(data)]
    assert rows(op11_merkle_manifest(llm, folder)) == sorted(expected, key=repr)
