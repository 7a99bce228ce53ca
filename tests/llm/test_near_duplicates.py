import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from spindrift.llm import near_duplicates as N
from spindrift.llm.components import connected_components

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def shingle_set(text):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def brute(rows):
    """Classes of (id, text) rows, as a list of class ids."""
    texts = {t for _, t in rows if t is not None}
    sets = {t: shingle_set(t) for t in texts}
    parent = {t: t for t in texts}

    def find(t):
        while parent[t] != t:
            t = parent[t]
        return t

    by = defaultdict(list)
    for t, s in sets.items():
        for g in s:
            by[g].append(t)
    for near in by.values():
        for t in near[1:]:
            for o in near:
                if o != t and find(o) != find(t) and len(sets[o] & sets[t]) >= 0.8 * len(sets[o] | sets[t]):
                    parent[find(o)] = find(t)
    least = defaultdict(list)
    for i, t in rows:
        if t is not None and i is not None:
            least[find(t)].append(i)
    return [i if t is None else min(least[find(t)], default=None) for i, t in rows]


def classes(df, **options):
    return sorted(((r.id, r.class_id) for r in N.near_duplicate_classes(df, **options).collect()), key=repr)


def test_components(spark):
    random.seed(3)
    edges = [(random.randrange(300), random.randrange(300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5), (7, 8), (8, 7)]
    group = {n: n for e in edges for n in e}
    for _ in range(400):
        for u, v in edges:
            group[u] = group[v] = min(group[u], group[v])
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got.get(n, n) == c for n, c in group.items())
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_documents_against_brute_force(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.collect()]
    assert classes(df) == sorted(zip([i for i, _ in rows], brute(rows), strict=True), key=repr)


def test_groups_and_odd_rows(spark):
    random.seed(4)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = [(900, None), (901, None), (902, ""), (903, ""), (904, " . "), (905, "one two"), (906, "One, two!"), (907, "one"), (None, "one two"), (None, None)]
    for g in range(12):
        base = random.choices(vocabulary, k=random.choice([12, 40, 200]))
        for j in range(random.choice([1, 2, 9])):
            w = list(base)
            for _ in range(len(base) // 60):
                w[random.randrange(len(w))] = random.choice(vocabulary)
            rows.append((g * 20 + j, " ".join(w)))
    rows += [rows[12], rows[12], (3, "an id that stands twice, with other text")]
    rows.append((950, "very long text " * 60_000))
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, class_id int, band string")
    want = sorted(zip([i for i, _ in rows], brute(rows), strict=True), key=repr)
    assert classes(df) == want
    assert classes(df, weighting="count")[-1] == want[-1]
    kept = N.keep_first(df)
    assert kept.columns == df.columns
    got = [(r.doc_id, r.text) for r in kept.collect()]
    alike = {r.id: r.class_id for r in N.near_duplicate_classes(df).collect()}
    assert {c for c in alike.values()} == {alike[i] for i, _ in got}
    assert len(got) == len(set(got)) and sum(t is None for _, t in got) == 3
    twice = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (1, "d e"), (2, "d e"), (4, None), (4, None)], "doc_id long, text string")
    assert sorted(map(tuple, N.keep_first(twice).collect()), key=repr) == [(1, "a b c"), (1, "d e"), (4, None), (4, None)]


def linked_classes(texts):
    """Classes of distinct texts, compared all with all."""
    sets = [shingle_set(t) for t in texts]
    many = Counter(g for s in sets for g in s)
    place = {g: i for i, g in enumerate(g for g, n in many.items() if n > 1)}
    has = np.zeros((len(texts), len(place)), dtype=np.float32)
    for i, s in enumerate(sets):
        has[i, [place[g] for g in s if g in place]] = 1
    both, size = has @ has.T, np.array([len(s) for s in sets])
    label = np.arange(len(texts))
    for i, j in np.argwhere(both >= 0.8 * (size[:, None] + size[None, :] - both)):
        label[label == max(label[i], label[j])] = min(label[i], label[j])
    return [*enumerate(label.tolist())]


def test_large_class_with_many_borderers_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 100)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(200)]
    texts = []
    for i in range(1500):
        w = list(base)
        for _ in range(1 if i < 300 else 6):  # the first ones are one class, which most others only border on
            w[rng.randrange(200)] = f"x{rng.randrange(10**9)}"
        texts.append(" ".join(w))
    df = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").repartition(4)
    want = linked_classes(texts)
    assert 300 < len({c for _, c in want}) < 1200
    assert classes(df) == sorted(want, key=repr)


def test_large_group_with_few_links(spark):
    rng = random.Random(6)
    base = [f"w{i}" for i in range(200)]
    texts = []
    for _ in range(1500):
        w = list(base)
        for i in rng.sample(range(200), 4):
            w[i] = f"x{rng.randrange(10**9)}"
        texts.append(" ".join(w))
    df = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").repartition(4)
    want = linked_classes(texts)
    assert 20 < sum(i != c for i, c in want)
    assert classes(df) == sorted(want, key=repr)


@pytest.mark.parametrize("texts", [[], [None], ["", ""], ["a b c d e f"]])
def test_tiny_tables(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert classes(df) == sorted(zip(range(len(texts)), brute(list(enumerate(texts))), strict=True))
