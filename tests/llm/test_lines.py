import hashlib
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from forgeledger.llm.lines import shared_lines_removed

COLUMNS = ("doc_id", "n_lines", "n_dropped", "kept_text_sha256")


def key(line):
    line = re.sub(r"\A[\x20\x09-\x0d]+|[\x20\x09-\x0d]+\Z", "", line)
    line = re.sub("[A-Z]", lambda m: m[0].lower(), line)
    return line if len(line) >= 10 else None


def brute(rows):
    holders = defaultdict(set)
    for d, t in rows:
        for line in (t or "").split("\n"):
            if d is not None and key(line):
                holders[key(line)].add(d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if d is None or not key(x) or len(holders[key(x)]) < 2 or min(holders[key(x)]) == d]
        out.append((d, len(lines), len(lines) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest()))
    return sorted(out, key=repr)


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


# A filter that is much too small suspects nearly every line and must change nothing.
@pytest.mark.parametrize("bits", [None, 64])
def test_against_brute_force(awkward, supplied, rows, bits):
    for docs in (awkward, supplied, awkward.unionAll(awkward)):
        docs = docs.withColumns({"lost": F.lit(1), "line": F.lit(2)})
        assert rows(shared_lines_removed(docs, bits), *COLUMNS) == brute(pairs(docs))


def test_kept_text(llm, rows):
    docs = llm.createDataFrame([(2, "A shared line\nown 2\n\n"), (1, " a SHARED line "), (3, "a shared line")], "doc_id bigint, text string")
    found = rows(shared_lines_removed(docs), "doc_id", "n_dropped", "kept_text")
    assert found == [(1, 0, " a SHARED line "), (2, 1, "own 2\n\n"), (3, 1, "")]


def test_empty(awkward):
    assert shared_lines_removed(awkward.limit(0)).count() == 0
