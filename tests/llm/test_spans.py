import hashlib

import pytest
from pyspark.sql import functions as F

from forgeledger.llm.spans import repeated_spans_removed

COLUMNS = ("doc_id", "n_words", "n_removed", "kept_text_sha256")


def brute(rows, size=50):
    least = {}
    for d, t in rows:
        words = (t or "").encode().split()
        for i in range(len(words) - size + 1 if d is not None else 0):
            window = tuple(words[i : i + size])
            least[window] = min(d, least.get(window, d))
    out = []
    for d, t in rows:
        words = (t or "").encode().split()
        gone = set()
        for i in range(len(words) - size + 1 if d is not None else 0):
            if least[tuple(words[i : i + size])] < d:
                gone |= set(range(i, i + size))
        kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((d, len(words), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


# A filter that is much too small lets unique anchors through and must change nothing.
@pytest.mark.parametrize("bits", [None, 64])
def test_against_brute_force(awkward, supplied, rows, bits):
    for docs in (awkward, supplied, awkward.unionAll(awkward)):
        docs = docs.withColumns({"anchor": F.lit(1), "lost": F.lit(2)})
        assert rows(repeated_spans_removed(docs, bits), *COLUMNS) == brute(pairs(docs))


def test_empty(awkward):
    assert repeated_spans_removed(awkward.limit(0)).count() == 0
