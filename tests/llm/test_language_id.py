import math
import unicodedata
import zlib

import pytest
from pyspark.sql import functions as F

from spindrift.llm import language_id as L
from spindrift.llm import op_language_id
from spindrift.llm.training import remainder


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in op_language_id.query(spark, d).collect()}
    docs = spark.read.parquet(f"{d}/documents.parquet").collect()
    assert len(got) == len(docs)
    held = [(got[r.doc_id].lang_pred, r.lang) for r in docs if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert all(got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= got[r.doc_id].score <= 1 for r in docs)
    assert sum(a == b for a, b in held) / len(held) > 0.95


def plain_vector(text):
    """n-grams one by one, letters by their category."""
    spaced = []
    for c in text.lower():
        if unicodedata.category(c)[0] == "L":
            spaced.append(c)
        elif not spaced or spaced[-1] is not None:
            spaced.append(None)
    raw = (" " + "".join(" " if c is None else c for c in spaced) + " ").encode()
    count = [0] * L.DIMENSIONS
    for i in range(len(raw) - 2):
        a, b, c = raw[i : i + 3]
        for h in (a * 31, a * 257 + b + 7919, (a * 257 + b) * 65537 + c * 40503):
            count[((h * 2654435761) % 2**32) >> 20 & (L.DIMENSIONS - 1)] += 1
    logs = [math.log(1 + n) for n in count]
    length = math.sqrt(sum(x * x for x in logs))
    return [x / length for x in logs]


def plain_prediction(model, text):
    """The family of the greatest margin, then a vote of its languages, pair by pair, in plain Python."""
    if not text or not any(unicodedata.category(c)[0] == "L" for c in text):
        return "und", 0.0
    v = [*plain_vector(text), 1.0]
    margin = lambda w: sum(a * float(b) for a, b in zip(v, w, strict=True))
    share = lambda m: 1 / (1 + math.exp(-3 * m))
    family, sure = 0, 1.0
    if len(model.families) > 1:
        margins = [margin(w) for w in model.family_weights]
        family = margins.index(max(margins))
        sure = share(margins[family])
    inside = model.families[family]
    signed = {(i, j): (1 if i < j else -1) * margin(model.pairs[min(i, j), max(i, j)]) for i in inside for j in inside if i != j}
    votes = {i: (sum(signed[i, j] > 0 for j in inside if j != i), sum(signed[i, j] for j in inside if j != i)) for i in inside}
    winner = max(inside, key=lambda i: votes[i])
    return model.languages[winner], sure * (share(votes[winner][1] / (len(inside) - 1)) if len(inside) > 1 else 1)


def test_predictions_against_plain_python(spark):
    """Also: the sample and the model don't depend on how rows are dealt, as when tasks run again."""
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    model = L.fit(L.language_sample(docs.repartition(7, "text"), remainder("doc_id", 4) != 2))
    assert any(len(f) > 1 for f in model.families) or len(model.families) > 1
    got = {r.doc_id: r for r in op_language_id.query(spark, d).collect()}
    rows = docs.where("length(text) < 20000").collect()
    assert len(rows) > 100
    for r in rows:
        lang, score = plain_prediction(model, r.text)
        assert got[r.doc_id].lang_pred == lang and abs(got[r.doc_id].score - score) < 1e-4


def test_families_are_found():
    texts = {"en": "the cat and the dog with this thing that they then have", "nl": "de kat en de hond met dit ding dat zij dan hebben", "fr": "le chat et le chien avec cette chose que nous avons alors", "es": "el gato y el perro con esta cosa que nosotros tenemos entonces"}
    model = L.fit([(L.vector(t), k) for k, t in texts.items() for _ in range(3)])
    assert sum(map(len, model.families)) == 4
    assert all(model.predict(t)[0] == k for k, t in texts.items())


@pytest.mark.parametrize("langs", [[], ["en"], ["en", "de"]])
def test_odd_tables(spark, langs):
    rows = [(i, f"words of {k} here {k * 3}", k, 1.0) for i, k in enumerate(langs * 8)]
    odd = [(101, None, "en", 2.0), (102, "", "en", 0.0), (103, "123 !?", None, 0.0), (104, "long text " * 50_000, None, 0.0), (None, "words", None, 1.0), (102, "", "en", 0.0)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, score double")
    model = L.fit(L.language_sample(docs.where("doc_id < 100"), remainder("doc_id", 4) != 2))
    got = docs.select("doc_id", L.predict_language(spark, model, docs.text).alias("p")).collect()
    assert len(got) == len(rows) + 6
    by = {r.doc_id: r.p.lang_pred for r in got}
    assert by[101] == by[102] == by[103] == "und" and (by[104] == "und") == (not langs)
    assert docs.limit(0).select(L.predict_language(spark, model, docs.text)).count() == 0


def test_letters_are_those_of_category_l(spark):
    model = L.fit([(L.vector(t), k) for k, t in (("en", "the cat and the dog"), ("de", "der hund und die katze")) for _ in range(3)])
    assert [model.predict(t) for t in ("²½①Ⅷ", "_ 12 ٣", "\u0301")] == [("und", 0.0)] * 3
    assert all(model.predict(t)[0] != "und" for t in ("² a", "ª", "語", "ʰ"))


def test_many_languages_share_the_sample(spark):
    docs = spark.createDataFrame([(i, f"word{i % 30} of {i}", f"l{i % 30}") for i in range(600)], "doc_id long, text string, lang string")
    found = L.language_sample(docs, F.lit(True), per_language=10, total=90)
    assert len(found) == 90 and {k for _, k in found} == {f"l{i}" for i in range(30)}
    assert {k for _, k in L.language_sample(docs, F.lit(True), per_language=10, total=9)} == {f"l{i}" for i in range(30)}
