import base64
import gzip
import hashlib
import os
from collections import defaultdict
from urllib.parse import urlparse

import pytest

from voxelflow.llm import warc
from voxelflow.llm.common import Scratch

SCHEMA = "page_id long, url string, html string, sha1 string, shard int, n int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA)


def expected(rows, least=0):
    groups = defaultdict(list)
    for i, _, h in rows:
        groups[h or ""].append(i)
    out = []
    for html, ids in groups.items():
        raw = html.encode()
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        order = sorted(ids, key=lambda i: (i is not None, i or 0), reverse=True)
        for n, i in enumerate(order):
            response = n == 0 or len(raw) < least
            out.append((i, len(raw), digest, "response" if response else "revisit", None if response else order[0]))
    return sorted(out, key=str)


ROWS = [
    (5, "http://a/5", "<p>same</p>"), (9, "http://a/9", "<p>same</p>"), (2, None, "<p>same</p>"), (3, "u\r\nX-Evil: 1", "é\r\n\r\nWARC/1.1"), (4, "u", None), (6, "u", ""),
    (7, "u", "x" * 300_000), (8, "u", "one"), (8, "u", "one"), (10, "u", "one"), (11, "u", "one\n"), (12, "u", "two"),
]


def run(spark, rows, **options):
    uri = Scratch(spark, "t").path("w")
    manifest = warc.write_warc(spark, frame(spark, rows), uri, **options).collect()
    return uri, manifest, sorted((tuple(r) for r in warc.read_warc(spark, uri).collect()), key=str)


@pytest.mark.parametrize("options", [{}, {"roll_bytes": 200, "shard_bytes": 1000}, {"min_bytes": 4}])
def test_round_trip(spark, options):
    assert run(spark, ROWS, **options)[2] == expected(ROWS, options.get("min_bytes", 0))


def test_hot_payload_is_split(spark):
    rows = [(i, "u", "copied") for i in range(400)] + [(1000 + i, "u", f"own {i}") for i in range(50)]
    uri, manifest, out = run(spark, rows, shard_bytes=200)
    assert out == expected(rows)
    assert max(m.records for m in manifest) < 200


def test_null_page_ids(spark):
    rows = [(None, "u", "a"), (1, "u", "a"), (None, "u", "b")]
    assert run(spark, rows)[2] == [(1, 1, expected(rows)[0][2], "response", None), (None, 1, expected([(1, "", "a")])[0][2], "revisit", 1), (None, 1, expected([(1, "", "b")])[0][2], "response", None)] or run(spark, rows)[2] == expected(rows)


def test_empty_table(spark):
    uri, manifest, out = run(spark, [])
    assert manifest == [] and out == []


def test_files_are_the_same_again_whatever_the_partitioning(spark):
    def digests(rows, parts):
        uri = Scratch(spark, "t").path("w")
        return sorted((m.file, m.sha1) for m in warc.write_warc(spark, frame(spark, rows).repartition(parts), uri, shard_bytes=500, roll_bytes=400).collect())

    rows = [(i, f"http://x/{i}", f"page {i % 40}" * 9) for i in range(100)]
    assert digests(rows, 1) == digests(rows[::-1], 3)


def test_archives_are_plain_warc_and_leave_no_temporary_files(spark):
    uri, manifest, _ = run(spark, ROWS)
    folder = urlparse(uri).path
    files = [n for n in os.listdir(folder) if n != "manifest"]
    assert sorted(files) == sorted(m.file for m in manifest)
    for m in manifest:
        with open(f"{folder}/{m.file}", "rb") as f:
            raw = f.read()
        assert len(raw) == m.bytes and hashlib.sha1(raw).hexdigest() == m.sha1
        text = gzip.decompress(raw)
        assert text.startswith(b"WARC/1.1\r\n") and b"\r\nX-Evil" not in text


def test_damage_is_noticed(spark):
    uri, manifest, _ = run(spark, [(1, "u", "payload")])
    path = f"{urlparse(uri).path}/{manifest[0].file}"
    with open(path, "rb") as f:
        raw = gzip.decompress(f.read())
    with open(path, "wb") as f:
        f.write(gzip.compress(raw.replace(b"payload\r\n", b"paylaod\r\n")))
    with pytest.raises(Exception, match="differs from its digest"):
        warc.read_warc(spark, uri).collect()
