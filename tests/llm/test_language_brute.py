"""Operator 10 against plain NumPy: vectors, cosines, the choice and the rejection; odd column names."""

import re
from collections import Counter

import numpy as np

from tabreg.llm import language_id as L
from tabreg.llm.common import table

SF = "/root/testdata/sf0.001"


def test_predictions_equal_plain_cosines(spark):
    docs = table(spark, SF, "documents")
    model = L.learn(docs, sample=40, clusters=2)
    extra = [(10**6, None), (10**6 + 1, ""), (10**6 + 2, "1234 ..."), (10**6 + 3, "Zzyzx qqq xxj"), (10**6 + 4, "une phrase très courte " * 3000)]
    some = docs.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))
    got = {r["doc_id"]: r for r in L.predict(some, model).collect()}
    assert len(got) == some.count()
    for doc, text in some.collect():
        r = got[doc]
        if text is None or not L.has_letter(text.encode()):
            assert (r["lang_pred"], r["score"], r["rejected"]) == (L.UNKNOWN, 0.0, True)
            continue
        counts = L.counts([text.encode()])[0].astype(np.float64)
        v = np.log1p(counts) * model["idf"]
        v /= np.linalg.norm(v)
        cosines = [float(sum(a * b for a, b in zip(v[v > 0], c[v > 0], strict=True))) for c in model["centroids"].astype(np.float64)]
        best = int(np.argmax(cosines))
        assert abs(r["score"] - min(1.0, max(0.0, cosines[best]))) < 1e-4
        near = [model["langs"][i] for i, c in enumerate(cosines) if c > cosines[best] - 1e-4]
        assert r["lang_pred"] in near
        if abs(1 - cosines[best] - model["limits"][best]) > 1e-4:
            assert r["rejected"] == (1 - cosines[best] > model["limits"][best])


def test_counts_are_those_of_letters(monkeypatch):
    """Bins are sums over 2-grams and 3-grams of the letters, words set apart by single spaces."""
    text = "Ab, ça 12 ab! Ünder".encode()
    plain = b" " + b" ".join(text.translate(L._LETTERS).split()) + b" "
    grams = Counter(plain[i: i + n] for n in (2, 3) for i in range(len(plain) - n + 1))
    assert L.counts([text])[0].sum() == sum(grams.values())
    assert not re.search(rb"[0-9!,]", plain)
    whole = L.counts([text * 50])[0]
    monkeypatch.setattr(L, "SLICE_BYTES", 16)
    assert np.array_equal(L.counts([text * 50])[0], whole)


def test_dotted_names_and_an_id_on_several_texts(spark):
    docs = table(spark, SF, "documents").select("doc_id", "text", "lang")
    plain = L.learn(docs, sample=40)
    odd = docs.toDF("the.id", "te`xt", "lang.x")
    named = L.learn(odd, "the.id", "te`xt", "lang.x", sample=40)
    assert plain["langs"] == named["langs"] and np.array_equal(plain["centroids"], named["centroids"])
    twice = odd.union(spark.createDataFrame([(1, "the other text of this one", "en"), (1, "the other text of this one", "en")], odd.schema))
    got = L.predict(twice, named, "the.id", "te`xt").collect()
    assert len(got) == twice.count()


def test_text_ids_are_numbers_on_both_sides(spark):
    """``007`` is learned from, or held out, as 7."""
    rows = [(f"{i:04d}", "the text of a document", "en") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id string, text string, lang string")
    kept = {r["__id"] for r in L._learnable(df, "doc_id", "text", "lang").collect()}
    held = {i for i in range(40) if __import__("zlib").crc32(str(i).encode()) % 5 == 0}
    assert kept == set(range(40)) - held
