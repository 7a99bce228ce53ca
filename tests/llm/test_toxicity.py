import math
import random
import zlib

import pytest

from spindrift.llm import op_toxicity
from spindrift.llm import toxicity as X
from spindrift.llm.training import remainder


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    rows = {r.doc_id: r for r in op_toxicity.query(spark, d).collect()}
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for k, r in rows.items())
    held = [(rows[r.doc_id].predicted, r.toxic, rows[r.doc_id].score) for r in spark.read.parquet(f"{d}/labels.parquet").collect() if rows[r.doc_id].held_out]
    assert sum(p == 1 for p, t, _ in held if t) / sum(t for _, t, _ in held) > 0.93  # a few labels there have no word to go by
    assert sum(p == 1 for p, t, _ in held if not t) <= 0.005 * len(held)


def strongest(model, text):
    return max((s for s, _ in model.clauses(text)), default=0.0)


def test_grammar_orders_clauses():
    model = X.ToxicityModel()
    assert strongest(model, "what a fine day") == 0 == strongest(model, "you are not here") == strongest(model, "")
    assert strongest(model, "you are an idiot") > strongest(model, "he is not an idiot") > 0
    assert strongest(model, "he is an idiot") > strongest(model, "he says he is an idiot") > 0
    assert strongest(model, "you I will kill") > 0
    assert strongest(model, "bacteria that heat can kill") == 0
    assert strongest(model, "an idiot. a moron") > 0 == strongest(model, "an idiot. a. b. c. d. a moron")
    assert [m for _, m in model.clauses("you idiot")] == [[("idiot", ("targeted insult",))]]


def test_words_by_themselves_score_nothing(spark):
    d = "/root/testdata/sf0.01"
    documents, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    model = X.train(documents, labels, remainder("doc_id", 4) != 2)
    words = [*model.words, *X.SEEDS[X.INSULT].split(), *X.SEEDS[X.THREAT].split()]
    assert len(model.words) >= 5
    apart = " and so it goes on. and on." * 5
    texts = [f"here stands {w} among others" for w in words] + [f"{a}{apart} {b}" for a, b in zip(words, words[1:], strict=False)]
    assert {*model.scores(texts)} == {*model.scores(["here stands nothing among others"])}
    assert (model.scores([f"{w} and {w}" for w in model.words]) > model.scores([""])[0]).all()


def test_a_quotation_reaches_over_clauses():
    model = X.ToxicityModel()
    (a, m), (b, n) = model.clauses('“an idiot. a moron. you idiot” scum')
    assert m[0][1] == ("heaped insult", "reported") and a == 0.7 * 0.7
    assert [o for _, o in n] == [("targeted insult", "reported"), ("targeted insult",)] and b == 1.7


def labelled(spark, sample):
    return spark.createDataFrame([(i, t, y) for i, (t, y) in enumerate(sample)], "k long, t string, y int")


def test_copies_teach_nothing(spark):
    sample = [("some odd zzzword here", 1)] * 50 + [(f"w{chr(97 + i % 26)} bleh x{chr(97 + i % 25)} end", 1) for i in range(50)] + [("clean text here", 0)] * 100
    words, _ = X.learn_lexicon(labelled(spark, sample))
    assert "bleh" in words and "zzzword" not in words


def test_rare_insults_are_learned(spark):
    sample = [(f"a{chr(97 + i)} bleh b{chr(97 + i)}", 1) for i in range(5)] + [("other toxic text", 1)] * 95 + [("clean text here", 0)] * 900
    words, _ = X.learn_lexicon(labelled(spark, sample))
    assert "bleh" in words


def brute_lexicon(sample):
    """The same weights, word by word, in plain Python."""
    word, toxic, other = X._WORD, sum(y for _, y in sample), sum(1 - y for _, y in sample)
    n, m, contexts = {}, {}, {}
    for text, y in sample:
        found = word.findall(text.lower())
        for w in set(found):
            (n if y else m)[w] = (n if y else m).get(w, 0) + 1
        if y:
            for a, b, c in zip(["", *found], found, [*found[1:], ""], strict=False):
                contexts.setdefault(b, set()).add((a, c))
    n = {w: min(k, len(contexts[w])) for w, k in n.items()}

    def weight(k, j):
        odds = math.log((k + 0.5) / (toxic + 1)) - math.log((j + 0.5) / (other + 1))
        return min(1.0, odds / X.FULL_LOG_ODDS) if k >= X.MIN_CONTEXTS and odds >= X.MIN_LOG_ODDS else 0

    words = {w: x for w, k in n.items() if len(w) > 1 and (x := weight(k, m.get(w, 0)))}
    every = {w[:i] for w in {*n, *m} for i in X.STEM_CHARS if i < len(w)}
    size = {s: sum(k for w, k in n.items() if w.startswith(s) and len(w) > len(s)) for s in every}
    stems = {}
    for s in every:
        if sum(1 for w, k in n.items() if k and w.startswith(s) and len(w) > len(s)) >= X.MIN_ENDINGS:
            if x := weight(size[s], sum(k for w, k in m.items() if w.startswith(s) and len(w) > len(s))):
                stems[s] = x
    return words, {s: x for s, x in stems.items() if not any(t[:-1] == s and size[t] >= 0.97 * size[s] for t in stems)}


def test_lexicon_against_plain_python(spark):
    rng = random.Random(5)
    words = [a + b for a in ("slan", "grum", "oth", "plain", "sluggo") for b in ("", "ta", "tik", "ser", "mo", "nix", "ba")]
    sample = []
    for i in range(400):
        y = int(i % 4 == 0)
        sample.append((" ".join(rng.choice(words if y and rng.random() < 0.3 else words[14:28]) for _ in range(12)), y))
    got = X.learn_lexicon(labelled(spark, sample))
    for found, want in zip(got, brute_lexicon(sample), strict=True):
        assert want and found.keys() == want.keys() and all(abs(found[w] - want[w]) < 1e-9 for w in want)


def test_small_tables_teach_words(spark):
    d = "/root/testdata/sf0.001"
    documents, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    assert X.train(documents, labels, remainder("doc_id", 4) != 2).words


@pytest.mark.parametrize(("sf", "recall"), [("sf0.001", 0.5), ("sf0.01", 0.9)])  # sf0.001 has two toxic labels held out
def test_held_out_recall_on_small_tables(spark, sf, recall):
    d = f"/root/testdata/{sf}"
    rows = {r.doc_id: r for r in op_toxicity.query(spark, d).collect()}
    held = [(rows[r.doc_id].predicted, r.toxic) for r in spark.read.parquet(f"{d}/labels.parquet").collect() if rows[r.doc_id].held_out]
    toxic, clean = ([p for p, t in held if t == y] for y in (1, 0))
    assert sum(toxic) >= recall * len(toxic) and sum(clean) <= 0.02 * len(clean)


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, None, 0.5), (2, "", 0.1), (2, "you idiot", 0.2), (None, "x idiot " * 100_000, None)], "doc_id long, text string, score double")
    for rows in ([], [(1, 1), (2, 1)], [(1, 1), (2, 0), (2, 0)], [(1, None), (9, 0)]):
        model = X.train(docs, spark.createDataFrame(rows, "doc_id long, toxic int"), remainder("doc_id", 4) != 7)
        got = [r.s for r in docs.select(X.toxicity_score(spark, model, docs.text).alias("s")).collect()]
        assert len(got) == 4 and all(0 <= s <= 1 for s in got) and got[0] == got[1]
    assert docs.limit(0).select(X.toxicity_score(spark, model, docs.text)).count() == 0
