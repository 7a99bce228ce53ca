import math
import zlib

import numpy as np
import zstandard

from spindrift.llm import compression_quality as Q
from spindrift.llm import op_quality
from spindrift.llm.training import Logistic, remainder


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in op_quality.query(spark, d).collect()}
    assert len(rows) == spark.read.parquet(f"{d}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for k, r in rows.items())
    held = [(rows[r.doc_id].predicted, r.quality) for r in spark.read.parquet(f"{d}/labels.parquet").collect() if rows[r.doc_id].held_out]
    assert sum(p == q for p, q in held) / len(held) > 0.93


def plain_score(model, text):
    """The score by compressors made anew for every block, one text at a time."""
    raw, sizes = (text or "").encode(), []
    for words in (model.good, model.bad, None):
        size = 0
        for block in [raw[at : at + 4096] for at in range(0, len(raw), 4096)] or [b""]:
            options = {}
            if words is not None:
                options["dict_data"] = zstandard.ZstdCompressionDict(words)
                options["dict_data"].precompute_compress(level=3)
            packed = zstandard.ZstdCompressor(level=3, write_content_size=False, write_dict_id=False, **options).compress(block)
            back = zstandard.ZstdDecompressor(**options).decompress(packed, max_output_size=5000)
            assert back == block
            size += len(packed)
        sizes.append(size)
    good, bad, plain = sizes
    x = [(good - bad) / (good + bad + 8), good / (len(raw) + 1), plain / (len(raw) + 1), math.log(len(raw) + 1)]
    return float(model.calibrate(np.array([x]))[0])


def test_scores_against_plain_python(spark):
    """Also: the model doesn't depend on how its rows are dealt or ordered, as when tasks run again."""
    d = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    model = Q.train(docs.repartition(7, "text"), labels.repartition(3, "quality"), remainder("doc_id", 5) != 0)
    got = {r.doc_id: r.score for r in op_quality.query(spark, d).collect()}
    rows = docs.collect()
    assert len(got) == len(rows) and all(abs(got[r.doc_id] - plain_score(model, r.text)) < 1e-9 for r in rows)


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, None, 0.5), (2, "", 0.1), (2, "", 0.2), (None, "x " * 200_000, None)], "doc_id long, text string, score double")
    learn = remainder("doc_id", 5) != 0
    for rows in ([], [(1, 1), (2, 1)], [(1, 1), (2, 0), (2, 0)], [(1, None), (9, 0)]):
        labels = spark.createDataFrame(rows, "doc_id long, quality int")
        model = Q.train(docs, labels, learn)
        got = docs.select(Q.quality_score(spark, model, docs.text).alias("s")).collect()
        assert len(got) == 4 and all(0 <= r.s <= 1 for r in got)
        assert got[1].s == got[2].s == got[0].s
    assert docs.limit(0).select(Q.quality_score(spark, model, docs.text)).count() == 0


def test_parts_are_spaced_over_the_whole_text():
    long = bytes(range(65, 75))
    raw = b"".join(bytes([b]) * Q.PART_BYTES for b in long)
    assert [p[0] for p in Q.spaced(raw, 4)] == [long[0], long[3], long[6], long[9]]
    assert Q.spaced(b"x" * 100, 4) == [b"x" * 100] and Q.spaced(b"", 4) == []


def test_calibrator_converges_where_full_steps_overshoot():
    rng = np.random.default_rng(3)
    for scale in (0.05, 1.0, 30.0):
        x = rng.normal(size=(400, 4)) ** 3 * scale
        y, weight = (x[:, 0] > 0).astype(int), rng.uniform(0.1, 5, 400)
        model = Logistic(x, y, weight)
        a = model._expand(x)
        gradient = a.T @ (weight * (model(x) - y)) + 1e-2 * model.w
        assert np.abs(gradient).max() < 1e-3 * np.abs(a.T @ (weight * (0.5 - y))).max()
