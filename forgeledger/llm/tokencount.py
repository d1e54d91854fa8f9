"""Token counts of whole texts by looking words up, without shuffling any of them.

The tokenizer never joins what a blank separates, so a text has as many tokens as its words have
together. Two tiers give a word's number: a table of frequent words, made once and broadcast, and for
the others the tokenizer itself, whose answers each worker remembers.

The frequent words come from all texts: every task counts its words, forgets rare ones when it holds too
many, and sends its ``TASK_WORDS`` most frequent; of their sums the ``FREQUENT`` largest are broadcast, words
of at most ``LONGEST`` bytes, which bounds the table at two megabytes. What is in the table changes the
speed and never a count.

Columns ``doc_id`` and ``text`` are read. Null text counts as empty and has no tokens; rows without an id are
counted as well. An empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache
from heapq import nlargest

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .frames import per_batch

FREQUENT, TASK_WORDS, LONGEST = 32_768, 8_192, 64
#: Distinct words a task counts before it forgets the rarer half, and words a worker remembers.
COUNTED, REMEMBERED = 200_000, 400_000

_MARKS = b".,;:!?"


class WordTokens(dict):
    """The number of tokens of each word: the frequent ones, then those met so far."""

    def __init__(self, path: str):
        super().__init__()
        self.frequent: dict[bytes, int] = {}
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()

    def with_frequent(self, frequent: dict[bytes, int]) -> WordTokens:
        self.frequent = frequent
        self.update(frequent)
        return self

    def __missing__(self, word: bytes) -> int:
        head = word.rstrip(_MARKS)
        if head and head != word and head.decode().lower().isalpha():
            # Letters and the marks after them are separate pieces.
            n = self[head] + self[word[len(head) :]]
        else:
            n = len(self.tokenizer.encode(word.decode(), add_special_tokens=False).ids)
        if len(self) >= REMEMBERED + len(self.frequent):
            self.clear()
            self.update(self.frequent)
        self[word] = n
        return n


@lru_cache(maxsize=4)
def word_tokens(path: str) -> WordTokens:
    return WordTokens(path)


def words(text: str | None) -> list[bytes]:
    """Words between ASCII blanks, A-Z in lower case as the tokenizer has them, unless a special string may be there."""
    data = (text or "").encode()
    return (data if b"<|" in data else data.lower()).split()


def _frequent(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter[bytes] = Counter()
    for batch in batches:
        for text in batch.column(0).to_pylist():
            seen.update(words(text))
        if len(seen) > COUNTED:
            seen = Counter(dict(nlargest(COUNTED // 2, seen.items(), key=lambda x: x[1])))
    top = [x for x in nlargest(TASK_WORDS, seen.items(), key=lambda x: x[1]) if len(x[0]) <= LONGEST]
    yield pa.record_batch({"word": pa.array([w for w, _ in top], pa.binary()), "n": pa.array([n for _, n in top], pa.int64())})


def frequent_words(docs: DataFrame, tokenizer: str) -> tuple[bytes, np.ndarray]:
    """The most frequent words, joined by spaces, and their numbers of tokens."""
    sums = docs.select(F.col("text").cast("string")).mapInArrow(_frequent, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    top = [bytes(r.word) for r in sums.orderBy(F.desc("n"), "word").limit(FREQUENT).collect()]
    known = word_tokens(tokenizer).with_frequent({})
    return b" ".join(top), np.array([known[w] for w in top], np.uint16)


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 2048) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every document.

    ``tokenizer`` is the path, on every executor, of a tokenizer's file that drops white space.
    """
    table = docs.sparkSession.sparkContext.broadcast(frequent_words(docs, tokenizer))

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        joined, numbers = table.value
        known = word_tokens(tokenizer)
        if len(known.frequent) != len(numbers):
            known.with_frequent(dict(zip(joined.split(), numbers.tolist(), strict=True)))
        look, texts = known.__getitem__, batch.column(1).to_pylist()
        n = np.array([sum(map(look, words(t))) for t in texts], np.int64)
        return pa.record_batch(
            {
                "doc_id": batch.column(0),
                "n_bytes": pa.array([len((t or "").encode()) for t in texts], pa.int64()),
                "n_tokens": pa.array(n),
                "over_limit": pa.array(n > limit),
            }
        )

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return per_batch(rows, count, "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean")
