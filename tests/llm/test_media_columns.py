import hashlib
import json
import os
import zlib

import pytest

from spindrift.llm import media_columns as M
from spindrift.llm import op_media_columns


def expected(text):
    raw = (text or "").encode()
    payload = raw + b"\0" * (64 - len(raw) % 64 if len(raw) % 64 or not raw else 0)
    return len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])


def test_round_trip_of_documents(spark):
    d = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    rows = op_media_columns.query(spark, d).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == expected(texts[r.doc_id])
        image = M.png(M.payload_of(texts[r.doc_id]), r.n_bytes)
        assert (r.media_bytes, r.media_sha256) == (len(image), hashlib.sha256(image).hexdigest()) and r.feature == M.feature(M.payload_of(texts[r.doc_id]))


def test_odd_rows(spark):
    texts = [None, "", "x", "x" * 64, "é" * 32, "\0", "long " * 400_000, "x"]
    df = spark.createDataFrame([(i, t, "f") for i, t in enumerate(texts)] + [(None, "x", "g"), (2, "x", "h")], "doc_id long, text string, feature string").repartition(3)
    rows = M.media_columns(spark, df).collect()
    assert len(rows) == 10 and {r.doc_id for r in rows} == {None, *range(8)}
    by = {r.doc_id: r for r in rows}
    assert all((by[i].n_bytes, by[i].payload_bytes, by[i].payload_sha256, by[i].tail_crc32) == expected(t) for i, t in enumerate(texts))
    assert tuple(by[2])[1:] == tuple(by[7])[1:] == tuple(by[None])[1:]
    assert M.media_columns(spark, df.limit(0)).count() == 0


@pytest.mark.parametrize("planned", ["manifest", "archives"])
def test_ranges_own_each_member_once_and_failures_stay_apart(spark, planned):
    df = spark.createDataFrame([(i, f"text {i} " * (i % 40)) for i in range(200)], "doc_id long, text string").coalesce(2)
    manifest = M.store(df, range_bytes=2000)
    listed = spark.read.parquet(manifest).collect()
    paths = sorted({r.path for r in listed})
    assert len(listed) > 10 and sum(len(r.members) for r in listed) == 200
    archives = [[p, os.path.getsize(p.removeprefix("file://"))] for p in paths]
    with open(paths[0].removeprefix("file://"), "r+b") as f:
        f.seek(archives[0][1] // 2)
        f.write(b"\xff" * 4)
    spark.dataSource.register(M.ArchiveSource)
    found = {"manifest": manifest} if planned == "manifest" else {"archives": json.dumps(archives), "range_bytes": 500}
    load = lambda **o: spark.read.format("member_archive").options(**found, **o).load()
    rows = load(on_error="row").collect()
    assert len(rows) == 200 == len({(r.path, r.offset) for r in rows})
    bad = [r for r in rows if r.error]
    assert len(bad) == 1 and bad[0].data is None
    with pytest.raises(Exception, match="differs"):
        load().collect()


def test_keys_of_text_and_archives_of_failed_attempts(spark, monkeypatch):
    fresh = M.fresh_path

    def with_a_leftover(session, name):
        path = fresh(session, name)
        if name == "media":
            os.makedirs(path.removeprefix("file://"))
            open(f"{path.removeprefix('file://')}/000000-left.zip", "w").close()
        return path

    monkeypatch.setattr(M, "fresh_path", with_a_leftover)
    df = spark.createDataFrame([("a/b.c d%", "x"), ("", "y"), (None, "z")], "doc_id string, text string").coalesce(1)
    assert {r.doc_id for r in M.media_columns(spark, df).collect()} == {"a/b.c d%", "", None}
    (path,) = {r.path for r in spark.read.parquet(M.store(df)).collect()}
    assert os.listdir(os.path.dirname(path.removeprefix("file://"))) == [os.path.basename(path)]
