import zlib
from collections import defaultdict

import public_tokenizers
from tokenizers import Tokenizer

from spindrift.llm import op_packing, op_packing_examples, packing
from spindrift.llm.op_packing import VOCABULARY

LIBRARY = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def check(rows, texts):
    """``texts`` by doc_id; every id in exactly one piece, every sequence gapless and within limits."""
    ids = {k: b"".join(i.to_bytes(4, "little") for i in [*LIBRARY.encode(t or "", add_special_tokens=False).ids, 0]) for k, t in texts.items()}
    documents, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        documents[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert documents.keys() == ids.keys()
    for k, pieces in documents.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids[k]) // 4
            at += r.length
            assert r.ids_crc32 == zlib.crc32(ids[k][4 * r.start : 4 * at])
        assert at == len(ids[k]) // 4
    padding = total = 0
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024 and len(pieces) <= packing.MAX_SEGMENTS
        total += at
        padding += 0 if at & (at - 1) == 0 else 1024 - at
    return padding / total


def test_small_table(spark):
    texts = {1: None, 2: "", 3: "one two", 4: "word " * 5000, 5: "x", 6: "a b c " * 300}
    df = spark.createDataFrame([(k, t, 7) for k, t in texts.items()], "doc_id long, text string, sequence_id int")
    check(packing.pack_documents(df, VOCABULARY).collect(), texts)
    assert packing.pack_documents(df.limit(0), VOCABULARY).count() == 0


def test_documents(spark):
    d = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    assert check(op_packing.query(spark, d).collect(), texts) < 0.02


def test_tiny_rows_need_little_padding(spark):
    texts = {i: "a b" for i in range(5000)}
    df = spark.createDataFrame([*texts.items()], "doc_id long, text string").coalesce(1)
    assert check(packing.pack_documents(df, VOCABULARY).collect(), texts) < 0.02


def test_repeated_and_null_ids(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c")], "doc_id long, text string")
    rows = packing.pack_documents(df, VOCABULARY).collect()
    assert sum(r.length for r in rows) == 3 + 3 + 2 and sum(r.doc_id is None for r in rows) >= 1


def test_examples_keep_all_limits(spark):
    rows = [(i, 50 + i % 200, 1 + i % 5, (i * 7) % 90) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, tokens long, segments long, loss long")
    limits = packing.Limits(1024, 12, 300)
    found = packing.pack_examples(df, "id", "tokens", "segments", "loss", limits).collect()
    by = {str(r[0]): r[1:] for r in rows}
    used = defaultdict(lambda: [0, 0, 0])
    for r in found:
        used[r.sequence_id] = [a + b for a, b in zip(used[r.sequence_id], by[r.key], strict=True)]
    assert sorted(r.key for r in found) == sorted(by)
    assert all(a <= b for u in used.values() for a, b in zip(u, (1024, 12, 300), strict=True))
    least = max(sum(v[i] for v in by.values()) / c for i, c in enumerate((1024, 12, 300)))
    assert len(used) <= 1.15 * least + 4
    few = packing.pack_examples(df, "id", "tokens", "segments", "loss", packing.Limits(100, 3, 50)).collect()
    over = {str(r[0]) for r in rows if r[1] > 100 or r[2] > 3 or r[3] > 50}
    assert {r.key for r in few if r.sequence_id is None} == over == {r.key for r in few if r.position is None} and len(few) == 3000


def test_odd_examples(spark):
    df = spark.createDataFrame([("a", None, 1, -5), (None, 5, 1, 1), ("a", 5, 1, 1)], "id string, tokens int, segments int, loss int")
    rows = packing.pack_examples(df.coalesce(1), "id", "tokens", "segments", "loss", packing.Limits(10, 3, 2)).collect()
    assert sorted(((r.key, r.tokens, r.loss) for r in rows), key=repr) == [("a", 0, 0), ("a", 5, 1), (None, 5, 1)] and {r.sequence_id for r in rows} == {0}
    assert packing.pack_examples(df.limit(0), "id", "tokens", "segments", "loss", packing.Limits()).count() == 0


def test_conversations_against_brute_force(spark):
    d = "/root/testdata/sf0.1"
    turns = spark.read.parquet(f"{d}/conversations.parquet").collect()
    want = defaultdict(lambda: [0, 0, 0])
    for r in turns:
        n = len(LIBRARY.encode(r.text or "", add_special_tokens=False).ids) + 1
        w = want[str(r.conv_id)]
        w[0], w[1], w[2] = w[0] + n, w[1] + 1, w[2] + n * (r.role == "assistant")
    limits = op_packing_examples.LIMITS
    caps = [limits.tokens, limits.segments, limits.loss]
    rows = op_packing_examples.query(spark, d).collect()
    assert {r.key: [r.tokens, r.segments, r.loss] for r in rows} == want and len(rows) == len(want)
    used, places = defaultdict(lambda: [0, 0, 0]), defaultdict(list)
    for r in rows:
        assert (r.sequence_id is None) == any(a > b for a, b in zip(want[r.key], caps, strict=True))
        if r.sequence_id is not None:
            used[r.sequence_id] = [a + b for a, b in zip(used[r.sequence_id], want[r.key], strict=True)]
            places[r.sequence_id].append(r.position)
    assert all(sorted(p) == [*range(len(p))] for p in places.values())
    assert all(a <= b for u in used.values() for a, b in zip(u, caps, strict=True))
    # each limit is the tightest one of some sequences, and full there
    tightest = [max(range(3), key=lambda i: u[i] / caps[i]) for u in used.values() if max(x / c for x, c in zip(u, caps, strict=True)) >= 0.98]
    assert {*tightest} == {0, 1, 2}
    bound = max(sum(u[i] for u in used.values()) / caps[i] for i in range(3))
    assert len(used) <= 1.1 * bound + 8


def test_odd_conversations(spark):
    df = spark.createDataFrame([(1, "user", None, 0), (1, "assistant", "a b", 0), (None, None, "x", 0), (None, "assistant", "", 0)], "conv_id long, role string, text string, tokens int")
    got = {r.conv_id: (r.tokens, r.segments, r.loss) for r in packing.conversation_demands(df, VOCABULARY).collect()}
    assert got == {1: (4, 2, 3), None: (3, 2, 1)}
