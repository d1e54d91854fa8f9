import hashlib
import re

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from forgeledger.llm import fim

UNIT = re.compile("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    n = len(units)
    digest = sha(f"42:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    x, y = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = ("".join(units[a:b]) for a, b in ((0, x), (x, y), (y, n)))
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 50:
        return doc_id, n, "plain", None, None, text
    if h4 % 100 < 80:
        return doc_id, n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return doc_id, n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def odd(llm):
    """Ids enough for every form, with texts that hold sentinels or parts of them."""
    texts = ["a <P> b", "<M>", "x <S", "<P", "< P> <", "<<P<S<M", "é\x85ü  中文 \t", "\n", " a", "a ", None, ""]
    return llm.createDataFrame([(i, texts[i % len(texts)]) for i in range(300)] + [(None, "a b c")], "doc_id bigint, text string")


def test_against_brute_force(llm, awkward, supplied, rows):
    for docs in (awkward, supplied, odd(llm)):
        docs = docs.withColumn("output", F.lit("clash")).withColumn("n", F.lit("clash"))
        made = fim.rearrange(docs)
        expected = sorted((brute(d, t) for d, t in pairs(docs)), key=repr)
        assert rows(made, "doc_id", "n", "form", "prefix_chars", "middle_chars", "output") == expected
        back = fim.restore(made)
        assert rows(back, "doc_id", "restored") == sorted(((d, t or "") for d, t in pairs(docs)), key=repr)
        digests = [(e[0], sha(e[5]), sha(t or "")) for e, (d, t) in zip([brute(*p) for p in pairs(docs)], pairs(docs), strict=True)]
        assert rows(back, "doc_id", "output_sha256", "restored_sha256") == sorted(digests, key=repr)


def test_descriptors_describe_the_output(llm, rows):
    docs = odd(llm)
    texts = dict(pairs(docs))
    for row in fim.rearrange(docs).collect():
        buffers = (texts[row.doc_id] or "").encode(), b"<P><S><M>"
        assert b"".join(buffers[b][s : s + n] for b, s, n in row.pieces).decode() == row.output
        assert {row.form for row in [row]} <= {"plain", "psm", "spm"}


def test_every_form_occurs(llm):
    assert {r.form for r in fim.rearrange(odd(llm)).select("form").distinct().collect()} == {"plain", "psm", "spm"}


def test_empty(awkward):
    assert fim.restore(fim.rearrange(awkward.limit(0))).count() == 0


@pytest.mark.parametrize("form", list(fim.ORDERS))
@given(st.lists(st.text("<>PSM a", max_size=6), min_size=3, max_size=3))
def test_round_trip_of_any_cut(form, parts):
    parts = [re.sub("<[PSM]>", "", p) for p in parts]
    text = "".join(parts)
    if re.search("<[PSM]>", text):
        return
    raw = [p.encode() for p in parts]
    table = fim.PieceTable((text.encode(), b"<P><S><M>"), [(0, 0, len(text.encode()))])
    table.cut((len(raw[0]), len(raw[0]) + len(raw[1])))
    table.pieces += [(1, 0, 3), (1, 3, 3), (1, 6, 3)]
    table.arrange(fim.ORDERS[form])
    prefix, middle, suffix = parts
    wanted = {"psm": f"<P>{prefix}<S>{suffix}<M>{middle}", "spm": f"<S>{suffix}<P>{prefix}<M>{middle}"}[form]
    assert table.text() == wanted and table.sha256() == sha(wanted)
    assert fim.original(wanted.encode(), form).text() == text


@given(st.text("a é\n\x0b<", max_size=30))
def test_units(text):
    import numpy as np

    raw = text.encode()
    ends = fim.unit_ends(np.frombuffer(raw, np.uint8))
    begin = [0, *ends[:-1]]
    assert [raw[a:b].decode() for a, b in zip(begin, ends, strict=False)] == UNIT.findall(text)
