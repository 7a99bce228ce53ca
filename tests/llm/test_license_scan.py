import math
import random
import re

import duckdb

from spindrift.llm import license_scan as L
from spindrift.llm import op_license_scan

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def base(text):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    places = sorted((i, label) for p, label in L.PHRASES for i in range(len(w)) if w[i : i + len(p.split())] == p.split())
    return len(w), len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(sorted({x for _, x in places}))


def test_documents_against_brute_force(spark):
    d = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    rows = op_license_scan.query(spark, d).collect()
    assert len(rows) == len(texts) and any(r.n_base for r in rows)
    for r in rows:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base(texts[r.doc_id])
        assert 0 <= r.score <= 1 and set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""}
        assert ("gpl-3" in r.labels) == ("GNU General Public License, version 3" in texts[r.doc_id])


def brute(text, frequencies, n):
    """Every template at every place, word by word: labels and score."""
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    labels, score = set(), 0.0
    for t in L.TEMPLATE_LIST:
        words = [x.decode() for x in t.words]
        idf = [math.log((n + 1) / (frequencies.get(x, 0) + 0.5)) for x in words]
        for at in range(-len(words), len(w)):
            stands = [0 <= at + j < len(w) and w[at + j] == x for j, x in enumerate(words)]
            if all(stands[a + i] for a, p in t.phrases for i in range(len(p))):
                share = sum(x for x, s in zip(idf, stands, strict=True) if s) / sum(idf)
                if share >= t.least - 1e-9:
                    labels.add(t.label)
                    score = max(score, share)
    return ",".join(sorted(labels)), score


def test_labels_and_scores_against_brute_force(spark):
    rng = random.Random(2)
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    for _ in range(120):
        words = []
        for _ in range(rng.randrange(1, 4)):
            t = [x.decode() for x in rng.choice(L.TEMPLATE_LIST).words]
            t = t[rng.choice([0, 0, 1, 3]) : len(t) - rng.choice([0, 0, 2, 9])]
            for _ in range(rng.choice([0, 0, 1, 5, len(t) // 3])):
                if t:
                    t[rng.randrange(len(t))] = rng.choice(["the", "software", "of", "zzz"])
            words += [rng.choice(["the", "license", "x"]) for _ in range(rng.randrange(4))] + t
        texts.append(rng.choice([" ", ", "]).join(words))
    df = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    sets = [set(WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))) for t in texts]
    frequencies = {w.decode(): sum(w.decode() in s for s in sets) for w in L.VOCABULARY}
    got = {r.doc_id: r for r in L.scan_licenses(spark, df).collect()}
    want = {i: brute(t, frequencies, len(texts)) for i, t in enumerate(texts)}
    assert len({labels for labels, _ in want.values()}) > 20
    for i, (labels, score) in want.items():
        assert got[i].labels == labels and abs(got[i].score - score) < 1e-9, texts[i]


def test_base_columns_against_sql(spark):
    d = "/root/testdata/sf0.01"
    phrases = ", ".join(f"('{p}', '{label}', {len(p.split())})" for p, label in L.PHRASES)
    want = duckdb.sql(
        f"""WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM '{d}/documents.parquet'),
        p(phrase, label, n) AS (VALUES {phrases}),
        places AS (SELECT doc_id, label, i FROM (SELECT doc_id, w, label, phrase, n, unnest(range(1, len(w) + 1)) AS i FROM d, p) WHERE array_to_string(w[i:i + n - 1], ' ') = phrase)
        SELECT d.doc_id, len(w), count(i), min(i) - 1, max(i) - 1, coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') FROM d LEFT JOIN places USING (doc_id) GROUP BY ALL"""
    ).fetchall()
    got = op_license_scan.query(spark, d).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_odd_texts(spark):
    texts = [None, "", "x", "CC BY-NC", "cc by nc by-nc cc by, NC", "under the MIT license under the mit license", "gnu general public license", "This is work licensed under the GNU General Public License, version 3.", "All rights. reserved?", "license " * 100_000, "the mit der general", "Été apache license version 2é", "public license version 3"]
    df = spark.createDataFrame([(i, t, "q") for i, t in enumerate(texts)] + [(None, "cc by nc", "q")] * 2, "doc_id long, text string, labels string")
    got = L.scan_licenses(spark, df).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(texts) + 2 and sum(r.doc_id is None and r.n_base == 1 for r in got) == 2
    assert all((by[i].n_words, by[i].n_base, by[i].first_word, by[i].last_word, by[i].base_labels) == base(t) for i, t in enumerate(texts))
    assert [by[i].labels for i in (0, 3, 4, 7, 8, 9, 11, 12)] == ["", "cc-by-nc", "cc-by-nc", "gpl-3", "proprietary", "", "", ""]
    assert by[0].score == 0 and by[3].score == 1
    assert L.scan_licenses(spark, df.limit(0)).count() == 0
