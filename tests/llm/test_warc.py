import base64
import gzip
import hashlib
import io
import random
import uuid
from collections import defaultdict

import pyarrow.fs
import pytest
from pyspark.sql import functions as F

from forgeledger.llm import warc

COLUMNS = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
SCHEMA = "page_id bigint, url string, html string"


def brute(rows, least=0):
    payloads = defaultdict(list)
    for p, _, html in rows:
        payloads[html or ""].append(p)
    out = []
    for p, _, html in rows:
        data = (html or "").encode()
        known = [x for x in payloads[html or ""] if x is not None]
        head = max(known, default=None) if len(data) >= least and len(payloads[html or ""]) > 1 else None
        revisit = head is not None and head != p
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        out.append((p, len(data), digest, "revisit" if revisit else "response", head if revisit else None))
    return sorted(out, key=repr)


def awkward():
    draw = random.Random(5)
    noise = ["".join(draw.choices("ab<>é\r\n", k=draw.randint(0, 5000))) for _ in range(40)]
    rows = [(i, f"http://x/{i}\r\nX: y", h) for i, h in enumerate(noise)]
    rows += [(100, None, None), (101, "", ""), (102, "u é %", noise[0]), (103, "v", noise[0]), (103, "v", noise[0]), (104, "w", "z" * 3_000_000)]
    return rows + [(None, "n", "nobody"), (None, "n", noise[1]), (-7, "m", "nobody"), (105, "q", "\x1f\x08 WARC/1.1\r\n\r\n")]


@pytest.mark.parametrize("split", [1 << 24, 1000, 37])
def test_round_trip_with_ranges_of_any_size(llm, rows, split):
    pages = llm.createDataFrame(awkward(), SCHEMA).withColumns({"digest": F.lit(1), "head": F.lit(2)}).repartition(3)
    if split == 37:
        pages = pages.where("page_id < 15")
    manifest = warc.write(pages)
    found = warc.read(manifest, split)
    assert rows(found, *COLUMNS) == brute([tuple(r) for r in pages.select("page_id", "url", "html").collect()])
    assert manifest.agg(F.sum("records")).first()[0] == pages.count()
    few = warc.read(manifest, split, readers=2)
    assert few.rdd.getNumPartitions() <= 2 and few.count() == pages.count()


def test_supplied_pages_and_payloads(llm, rows):
    pages = llm.read.parquet("/root/testdata/sf0.001/pages.parquet")
    found = warc.read(warc.write(pages))
    assert rows(found, *COLUMNS) == brute([tuple(r) for r in pages.select("page_id", "url", "html").collect()])
    html = {r.page_id: r.html for r in pages.collect()}
    for r in found.where("record_type = 'response'").collect():
        assert bytes(r.payload).decode() == html[r.page_id]


def test_small_payloads_are_written_whole(llm, rows):
    pages = llm.createDataFrame([(1, "a", "same"), (2, "b", "same"), (3, "c", "longer text"), (4, "d", "longer text")], SCHEMA)
    found = warc.read(warc.write(pages, min_bytes=5))
    assert rows(found, *COLUMNS) == brute([tuple(r) for r in pages.collect()], 5)


def test_archives_are_plain_gzip_members(llm):
    pages = llm.createDataFrame([(1, "http://a/", "one"), (2, "http://b/", "one")], SCHEMA).coalesce(1)
    path = warc.write(pages).first().path
    store, name = pyarrow.fs.FileSystem.from_uri(path)
    text = gzip.decompress(store.open_input_file(name).read()).decode()
    assert text.count("WARC/1.1\r\n") == 2 and "WARC-Refers-To: <urn:x-page:2>" in text


def test_magic_bytes_inside_a_member_are_no_record():
    inner = warc.record(9, None, b"inner", None)
    stored = gzip.compress(b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x-page:1>\r\nContent-Length: 0\r\n\r\n\r\n\r\n", 0)
    data = warc.MAGIC + b"chance" + warc.record(1, "u", b"x" * 50_000, None) + b"\x1f\x8b\x08\x00" + stored + inner[: len(inner) - 9]
    found = [warc.parsed(r)[0] for r in warc.records(io.BytesIO(data), 0, len(data))]
    assert found == [1, 1]


def test_lost_attempts_are_not_read(llm):
    folder = f"/tmp/checkpoints/forgeledger-test-{uuid.uuid4().hex}"
    pages = llm.createDataFrame([(1, "a", "x")], SCHEMA)
    first, second = warc.write(pages, folder), warc.write(pages, folder)
    assert warc.read(first).count() == warc.read(second).count() == 1


@pytest.mark.parametrize("split", [1 << 24, 50])
@pytest.mark.parametrize("damage", ["crc", "magic", "first", "cut", "boundary"])
def test_damaged_archives_raise(llm, damage, split):
    pages = llm.createDataFrame([(i, f"http://x/{i}", f"page {i} " * 9) for i in range(4)], SCHEMA).coalesce(1)
    manifest = warc.write(pages)
    assert warc.read(manifest, split).count() == 4
    path = manifest.first().path
    store, name = pyarrow.fs.FileSystem.from_uri(path)
    with store.open_input_file(name) as source:
        data = bytearray(source.read())
    second = data.index(warc.MAGIC, 1)
    last = data.rindex(warc.MAGIC)
    if damage == "crc":
        data[last - 8] ^= 1
    elif damage in ("magic", "first"):
        data[second if damage == "magic" else 0] ^= 1
    else:
        data = data[: -9 if damage == "cut" else last]
    with store.open_output_stream(name, compression=None) as out:
        out.write(bytes(data))
    if damage == "cut":
        manifest = manifest.withColumn("bytes", F.lit(len(data)).cast("bigint"))
    with pytest.raises(Exception, match="damaged or cut off|the manifest says"):
        warc.read(manifest, split).count()


def test_empty(llm):
    assert warc.read(warc.write(llm.createDataFrame([], SCHEMA))).count() == 0
