import hashlib
import random
import re

import pytest

from spindrift.llm import decontamination as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def listed(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items, n=10):
    w, hit, found = listed(text), set(), set()
    for item, t in items:
        v = listed(t)
        for i in range(max(len(v) - n, 0) + 1 if v else 0):
            g = v[i : i + n]
            for j in range(len(w) - len(g) + 1):
                if w[j : j + len(g)] == g:
                    hit.update(range(j, j + len(g)))
                    if item is not None:
                        found.add(str(item))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


ITEMS = [(1, "One two three four five six seven eight nine ten eleven twelve"), (2, "Été à la PLAGE"), (10, "été à la plage"), (3, None), (4, "..."), (5, ""), (None, "zig zag")]
PARTS = ["one two three four five six seven eight nine ten", "two three four five six seven eight nine ten eleven twelve", "ÉTÉ à la plage", "été À la plage", "été, à la plage!", "zig. Zag", "noise", "more words here", "x\n", "\x00"]


@pytest.mark.parametrize("table", [True, False])
def test_against_brute_force(spark, monkeypatch, table):
    if not table:
        monkeypatch.setattr(D, "MAX_BROADCAST_BYTES", 0)
        monkeypatch.setattr(D, "MAX_TABLE_BITS", 1 << 10)  # a crowded table: most windows go to the join
        monkeypatch.setattr(D, "MAX_BROADCAST_BYTES", 0)
    random.seed(1)
    texts = [None, "", " . ", *(" ".join(random.choices(PARTS, k=random.randint(1, 9))) for _ in range(60))]
    rows = [(i, t, "x", 3) for i, t in enumerate(texts)] + [(7, texts[7], "y", 4), (7, "other one", "z", 5), (None, texts[9], "q", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, items string, n_words int")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = [tuple(r) for r in D.leak_report(docs, bench).collect()]
    assert sorted(got, key=repr) == sorted(((r[0], *brute(r[1], ITEMS)) for r in rows), key=repr)
    clean = D.remove_documents(docs, bench)
    assert clean.columns == docs.columns
    assert sorted(map(repr, clean.collect())) == sorted(repr(r) for r in docs.collect() if not brute(r.text, ITEMS)[-1])


def test_spans_are_cut_out(spark):
    rows = [(1, "a, One two three four five six seven eight nine ten eleven: b"), (2, "Clean  text."), (3, None), (4, "zig zag zig zag"), (5, "x zig, zag y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in D.remove_spans(docs, spark.createDataFrame(ITEMS, "item_id long, text string")).collect()}
    assert got == {1: "a,  : b", 2: "Clean  text.", 3: None, 4: " ", 5: "x   y"}


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r)[:4] for r in D.leak_report(docs, none).collect()] == [(1, 2, 0, 0)]
    assert D.leak_report(docs.limit(0), spark.createDataFrame(ITEMS, "item_id long, text string")).count() == 0
