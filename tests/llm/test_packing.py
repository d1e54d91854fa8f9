import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from forgeledger.llm import packing

PATH = str(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def expected_ids(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


def check(pieces, docs, tokenizer):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    for doc_id, text in docs:
        ids, at = np.array(expected_ids(tokenizer, text), "<u4"), 0
        for p in sorted(by_doc.pop(doc_id), key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            if "ids" in p:
                assert p.ids == ids[at : at + p.length].tolist()
            at += p.length
        assert at == len(ids)
    assert not by_doc
    for parts in by_sequence.values():
        at = 0
        for p in sorted(parts, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 2048


@pytest.mark.parametrize("group", [1 << 23, 5000])
def test_pieces_are_the_documents(awkward, supplied, tokenizer, monkeypatch, group):
    monkeypatch.setattr(packing, "GROUP_TOKENS", group)
    for docs in (awkward.where("doc_id is not null"), supplied):
        found = packing.pack(docs.withColumn("ids", F.lit(1)), PATH, with_ids=True).collect()
        check(found, [(r.doc_id, r.text) for r in docs.collect()], tokenizer)


def test_little_padding(supplied):
    pieces = packing.pack(supplied.coalesce(1), PATH).collect()
    used, sequences = sum(p.length for p in pieces), {p.sequence_id for p in pieces}
    assert used / (2048 * len(sequences)) > 0.97


def test_rows_without_id_and_empty(awkward):
    assert packing.pack(awkward, PATH).where("doc_id is null").count() >= 2
    assert packing.pack(awkward.limit(0), PATH).count() == 0


def test_parts_give_the_same_ids(tokenizer):
    draw, parts = random.Random(4), packing.PieceIds(PATH)
    atoms = [" ", "  ", "\n", " \n", "\t", "\xa0", "　", "\x1c", "\x85", "a", "Word", "'s", "don't", "12", "é", "é", "😀", "<|endoftext|>", ".", "!!", "_"]
    for _ in range(3000):
        text = "".join(draw.choices(atoms, k=draw.randint(0, 14)))
        assert np.frombuffer(parts.of(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_best_fit_takes_the_tightest_sequence():
    draw = random.Random(6)
    for _ in range(200):
        lengths = [draw.randint(1, 20) for _ in range(draw.randint(1, 60))]
        rooms, expected = [], {}
        for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
            fits = [r for r in rooms if r >= lengths[i]]
            before = min(fits) if fits else 20
            if fits:
                rooms.remove(before)
            rooms.append(before - lengths[i])
            expected[i] = 20 - before
        places = packing.best_fit(lengths, 20)
        assert [o for _, o in places] == [expected[i] for i in range(len(lengths))]
        assert len({s for s, _ in places}) == len(rooms)
