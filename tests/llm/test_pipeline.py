import corpus_pipeline
from spindrift.llm import compression_quality, toxicity
from tests.llm.test_decontamination import brute as leaks
from tests.llm.test_near_duplicates import brute as classes
from tests.llm.test_packing import check

D = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    labels = spark.read.parquet(f"{D}/labels.parquet")
    bench = [tuple(r) for r in spark.read.parquet(f"{D}/benchmark.parquet").collect()]
    columns = docs.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r.text for r in docs.collect()}
        out = stage(spark, docs, D)
        out.write.parquet(str(tmp_path / str(i)))
        rows = spark.read.parquet(str(tmp_path / str(i)))
        if i == 4:
            assert check(rows.collect(), before) < 0.03
            break
        assert rows.columns == columns
        after = {r.doc_id: r.text for r in rows.collect()}
        assert after.items() <= before.items()
        if i == 0:
            model = toxicity.train(docs, labels, corpus_pipeline.F.lit(True))
            want = {k for k, t in before.items() if model.scores([t])[0] < 0.3}
        elif i == 1:
            model = compression_quality.train(docs, labels, corpus_pipeline.F.lit(True))
            want = {k for k, t in before.items() if model.scores([t])[0] >= 0.3}
        elif i == 2:
            want = set(classes(list(before.items())))
        else:
            want = {k for k, t in before.items() if not leaks(t, bench)[-1]}
        assert after.keys() == want, name
        docs = rows


def test_run_gives_packed_rows(spark):
    rows = corpus_pipeline.run(spark, D).collect()
    assert rows and {"doc_id", "start", "length", "sequence_id", "offset"} <= set(rows[0].asDict())


def test_odd_rows_through_every_stage(spark, tmp_path):
    """Nulls in any column, empty and very long texts, repeated rows, columns of clashing names, an empty table."""
    good = spark.read.parquet(f"{D}/documents.parquet").limit(60)
    names = ["node", "band", "_key", "_hash", "w", "s", "h", "k", "t", "y", "score", "_id", "_first", "c", "rid"]
    odd = [(None, None), (None, "no id here at all"), (9001, None), (9001, None), (9002, ""), (9003, ""), (9004, "long text " * 60_000), (9005, "same row"), (9005, "same row"), (9006, "\x00 \n\t"), (9007, "日本語 ²½")]
    odd = spark.createDataFrame([(i, t, None, None, None) for i, t in odd], good.schema)
    docs = good.unionByName(odd)
    for j, n in enumerate(names):
        docs = docs.withColumn(n, corpus_pipeline.F.lit(None if j % 3 == 0 else j).cast("long"))
    columns, ids = docs.columns, {r.doc_id for r in docs.collect()}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        empty = stage(spark, docs.limit(0), D)
        assert empty.count() == 0
        out = stage(spark, docs, D)
        out.write.parquet(str(tmp_path / str(i)))
        rows = spark.read.parquet(str(tmp_path / str(i))).collect()
        assert {r.doc_id for r in rows} <= ids, name
        if i == 4:
            assert {r.doc_id for r in rows} == {r.doc_id for r in docs.collect()}
            break
        assert out.columns == empty.columns == columns, name
        assert all(r.k == 7 and r.w == 4 and r.node is None for r in rows), name
        if i == 2:
            kept = [(r.doc_id, r.text) for r in rows if r.doc_id is None or r.doc_id > 9000]
            before = {(r.doc_id, r.text) for r in docs.collect()}
            assert len(kept) == len(set(kept)) + ((9001, None) in before) and sum(t == "" for _, t in kept) <= 1
        docs = spark.read.parquet(str(tmp_path / str(i)))
