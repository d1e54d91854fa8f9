import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from forgeledger.llm import decontaminate
from forgeledger.llm import words as W


def shingles(words, size=5):
    return [tuple(words[i : i + size]) for i in range(len(words) - size + 1)]


def brute(docs, items):
    """The best of all windows of each document for each item."""
    out = []
    for doc_id, text in docs:
        words = (text or "").encode().lower().split()
        own = shingles(words)
        for item_id, item_text in items:
            item = (item_text or "").encode().lower().split()
            if 0 < len(item) < 5:
                places = [i for i in range(len(words) - len(item) + 1) if words[i : i + len(item)] == item]
                if places:
                    out.append((doc_id, item_id, 1.0, places[0]))
                continue
            want = Counter(shingles(item))
            if not item or not set(own) & set(want):
                continue
            n = sum(want.values())
            width, best = min(n, len(own)), None
            for s in range(len(own) - width + 1):
                both = sum((Counter(own[s : s + width]) & want).values())
                either = width + n - both
                if 100 * both >= 75 * either and (best is None or both / either > best[0]):
                    best = (both / either, s)
            if best:
                out.append((doc_id, item_id, *best))
    return sorted(out, key=repr)


def planted():
    draw = random.Random(12)
    word = lambda: "".join(draw.choices("abcdefgh", k=draw.randint(2, 5)))
    items = [(i, " ".join(word() for _ in range(draw.choice([3, 5, 6, 9, 20, 45, 60])))) for i in range(25)]
    items += [(90, None), (91, ""), (92, "w " * 30), (93, "a b a b a b a b c d"), (94, items[0][1]), (None, items[1][1])]
    docs = []
    for i in range(120):
        k = draw.randrange(25)
        words = items[k][1].split()
        for _ in range(draw.choice([0, 0, 1, 1, 2, 3, 5])):
            at = draw.randrange(len(words))
            words[at : at + draw.choice([0, 1, 1])] = [word()] * draw.choice([0, 1, 1])
            words = words or [word()]
        docs.append((i, " ".join([*[word() for _ in range(draw.randint(0, 60))], *words, *[word() for _ in range(draw.randint(0, 60))]]).title()))
    docs += [(200, "w " * 100), (201, "x a b a b a b a b c d y"), (202, None), (203, ""), (None, items[4][1]), (204, items[5][1]), (204, items[5][1])]
    return docs, items


def test_against_all_windows(llm, rows):
    docs, items = planted()
    frame = llm.createDataFrame(docs, "doc_id bigint, text string").withColumns({"item_id": F.lit(1), "similarity": F.lit(2)}).repartition(3)
    found = rows(decontaminate.leaks(frame, llm.createDataFrame(items, "item_id bigint, text string")))
    expected = brute(docs, items)
    assert len(expected) > 60
    assert found == expected


def test_supplied(llm, supplied, rows):
    benchmark = llm.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    expected = brute([(r.doc_id, r.text) for r in supplied.collect()], [(r.item_id, r.text) for r in benchmark.collect()])
    assert rows(decontaminate.leaks(supplied, benchmark)) == expected


def test_slices_change_nothing(llm, rows, monkeypatch):
    docs, items = planted()
    monkeypatch.setattr(decontaminate, "SLICE_BYTES", 900)
    frame, benchmark = llm.createDataFrame(docs, "doc_id bigint, text string"), llm.createDataFrame(items, "item_id bigint, text string")
    assert rows(decontaminate.leaks(frame, benchmark)) == brute(docs, items)
    leaked = {r[0] for r in brute(docs, items)}
    kept = decontaminate.clean(frame, benchmark)
    assert rows(kept) == sorted([d for d in docs if d[0] not in leaked], key=repr)


def test_empty_tables(llm, supplied, rows):
    nothing = llm.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.leaks(supplied, nothing).count() == 0
    assert decontaminate.clean(supplied, nothing).count() == supplied.count()
    assert decontaminate.leaks(supplied.limit(0), llm.read.parquet("/root/testdata/sf0.001/benchmark.parquet")).count() == 0


@pytest.mark.parametrize("size", [8, 20, 60, 200])
def test_radius_holds_every_similar_window(size):
    """Windows of exactly the least similarity, drawn at random, stay within the radius."""
    draw = np.random.default_rng(size)
    shared = -(-150 * size // 175)
    far = 0
    for _ in range(3000):
        a = draw.integers(0, 2**64, size, dtype=np.uint64)
        b = np.concatenate([a[:shared], draw.integers(0, 2**64, size - shared, dtype=np.uint64)])
        one, two = (decontaminate.fingerprints(W.mix(x), np.zeros(1, np.int64), size)[0] for x in (a, b))
        far = max(far, int(np.bitwise_count(one ^ two)))
    assert far <= decontaminate.RADIUS - 2


@pytest.mark.parametrize(("shared", "repeated"), [(44, 7), (100, 10), (100, 13), (190, 20), (190, 30)])
@pytest.mark.parametrize("kinds", [1, 3])
def test_radius_holds_windows_that_repeat_a_shingle(shared, repeated, kinds):
    draw = np.random.default_rng(shared + repeated)
    size, far = shared + repeated, 0
    for _ in range(1500):
        a = draw.integers(0, 2**64, size, dtype=np.uint64)
        b = np.concatenate([a[:shared], np.resize(draw.integers(0, 2**64, kinds, dtype=np.uint64), repeated)])
        one, two = (decontaminate.fingerprints(x, np.zeros(1, np.int64), size)[0] for x in (a, b))
        far = max(far, int(np.bitwise_count(one ^ two)))
    assert far <= decontaminate.RADIUS - 2


@pytest.mark.parametrize("size", [1, 3, 8, 40])
def test_running_votes_equal_those_of_each_window(size):
    draw = np.random.default_rng(size)
    hashes = W.mix(draw.integers(0, 12, 300).astype(np.uint64))
    starts = np.flatnonzero(draw.random(300 - size + 1) < 0.3)
    alone = [decontaminate.fingerprints(hashes[s : s + size], np.zeros(1, np.int64), size)[0] for s in starts]
    assert decontaminate.fingerprints(hashes, starts, size).tolist() == alone
    # The order of a window's shingles does not count.
    mixed = draw.permutation(hashes[:size])
    assert decontaminate.fingerprints(mixed, np.zeros(1, np.int64), size) == decontaminate.fingerprints(hashes[:size], np.zeros(1, np.int64), size)


def test_repeated_shingles_against_all_windows(llm, rows):
    items, docs = [], []
    for i in range(24):
        shared, n = [(44, 51), (100, 116), (190, 215), (190, 220)][i % 4]
        words = [f"w{i}x{k}" for k in range(n + 4)]
        held = [*words[: shared + 4], *["same"] * (n - shared)]
        # The item repeats, the document does, or both.
        items.append((i, " ".join(held if i % 3 == 1 else words)))
        docs.append((i, " ".join(["before", "it", *(words if i % 3 == 1 else held), "and", "after"])))
    docs.append((90, " ".join(["same"] * 300)))
    items.append((90, " ".join(["same"] * 150)))
    expected = brute(docs, items)
    assert len(expected) >= 25
    found = decontaminate.leaks(llm.createDataFrame(docs, "doc_id bigint, text string"), llm.createDataFrame(items, "item_id bigint, text string"))
    assert rows(found) == expected


def test_tables_find_all_within_the_radius():
    draw = np.random.default_rng(1)
    items = decontaminate._Items([(0, " ".join(f"w{i}" for i in range(30)))])
    own = decontaminate.fingerprints(items.counts[0][0], np.zeros(1, np.int64), 26)[0]
    prints = [own]
    for n in range(decontaminate.RADIUS + 6):
        flips = draw.permutation(64)[:n]
        prints.append(own ^ np.bitwise_or.reduce(np.uint64(1) << flips.astype(np.uint64), initial=np.uint64(0)))
    found = {w for w, _ in items.near(26, np.array(prints, np.uint64))}
    assert found == {i for i, p in enumerate(prints) if int(np.bitwise_count(p ^ own)) <= decontaminate.RADIUS}


def test_index_of_many_short_items():
    """The index of 20,000 items of equal length is small, quickly made, and finds what comparing all would."""
    import time

    draw = random.Random(3)
    word = lambda: "".join(draw.choices("abcdefgh", k=4))
    items = decontaminate._Items([(i, " ".join(word() for _ in range(10))) for i in range(20_000)])
    began = time.process_time()
    prints = np.array([decontaminate.fingerprints(items.counts[k][0], np.zeros(1, np.int64), 6)[0] for k in range(0, 20_000, 50)])
    found = set(items.near(6, prints))
    own, tables = items.index[6]
    assert tables.nbytes <= 256 * len(own) + 4096 and time.process_time() - began < 60
    all_pairs = np.bitwise_count(prints[:, None] ^ own) <= decontaminate.RADIUS
    assert found == {(int(w), int(i)) for w, i in zip(*np.nonzero(all_pairs), strict=True)}
