"""Operator 13 against brute force: every document scored for every item."""

import math
import random
import re
from collections import Counter

import pytest

from tabreg.llm import lexical_search as S

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k=10):
    held = [(d, Counter(terms(t))) for d, t in docs if terms(t)]
    n_docs, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        found = []
        for doc, c in held:
            m = 10 + (90 * sum(c.values()) * n_docs) // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m))
                        for t in set(terms(text)) if c[t])
            if score > 0:
                found.append((-score, doc is None, doc or 0, doc))
        out += [(item, rank, f[3], -f[0]) for rank, f in enumerate(sorted(found, key=lambda f: f[:3])[:k], 1)]
    return sorted(out, key=repr)


def made(rng, n, words):
    return " ".join(rng.choice(words) for _ in range(n))


def data():
    rng = random.Random(6)
    words = ["The", "of", "été", "42", "rare", "x", "日本", "stable", "in", "É"] + [f"w{i}" for i in range(30)]
    docs = [(i, made(rng, rng.choice([1, 4, 20, 90]), words)) for i in range(120)]
    docs += [(200 + i, docs[i % 7][1]) for i in range(60)]                    # copies: whole classes of ties
    docs += [(300 + i, docs[8][1] + f" unknown{i}") for i in range(25)]        # other words, same vector and length
    docs += [(400, None), (401, ""), (402, "... !"), (None, docs[3][1]), (None, docs[8][1]), (5, docs[5][1]), (5, "rare rare"), (403, "ſ ſ k K"),
             (-7, docs[8][1] + " unknown"), (404, "RARE-rare_rare")]
    rng.shuffle(docs)
    items = [(i, made(rng, rng.choice([1, 3, 12]), words + ["absent"])) for i in range(15)]
    items += [(20, None), (21, ""), (22, "absent"), (None, "rare"), (3, "of été"), (23, docs[0][1] or "x"), (24, " ".join(words))]
    return docs, items


def ran(spark, tmp_dir, docs, items, extra=""):
    spark.createDataFrame(docs, "doc_id long, text string" + extra).repartition(4).write.parquet(f"{tmp_dir}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_dir}/benchmark.parquet")
    return sorted((tuple(r) for r in S.op13_lexical_search(spark, tmp_dir).collect()), key=repr)


@pytest.mark.parametrize("shard", [S.SHARD_TERMS, 20])
def test_against_brute_force(spark, tmp_dir, shard, monkeypatch):
    monkeypatch.setattr(S, "SHARD_TERMS", shard)      # small: many passes, and an item larger than a shard
    monkeypatch.setattr(S, "CELLS", 50 if shard == 20 else S.CELLS)
    docs, items = data()
    assert ran(spark, tmp_dir, docs, items) == brute(docs, items)


def test_empty_tables(spark, tmp_dir):
    docs, items = data()
    assert ran(spark, f"{tmp_dir}/a", [], items) == []
    assert ran(spark, f"{tmp_dir}/b", docs, []) == []
    assert ran(spark, f"{tmp_dir}/c", [(1, None), (2, "")], items) == []


def test_a_large_class_and_clashing_columns(spark, tmp_dir):
    docs = [(i, "rare stable thing", i, "m") for i in range(900, 0, -1)] + [(0, "other words", 0, "m")]
    items = [(1, "stable"), (2, "words rare")]
    got = ran(spark, tmp_dir, docs, items, ", `hash` int, `vector` string")
    assert got == brute([d[:2] for d in docs], items)
    assert [r[2] for r in got if r[0] == 1 and r[1] == 1] == [1]


def test_very_long_text_is_split_in_parts(monkeypatch):
    text = ("Ab-cd éÉ 9 " * 300).encode()
    for part in (1, 7, 1000):
        monkeypatch.setattr(S, "PART", part)
        assert [t.decode() for p in S.term_parts(text) for t in p] == terms(text.decode())
