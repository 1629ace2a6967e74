"""Operator 12 against brute force over byte windows."""

import hashlib
import random

import pytest

from tabreg.llm import suffix_dedup as S

WINDOW = S.WINDOW


def brute(rows):
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of each row, by the contract's words."""
    least = {}
    for doc, text in rows:
        raw = (text or "").encode()
        for p in range(len(raw) - WINDOW + 1):
            if doc is not None:
                w = raw[p: p + WINDOW]
                least[w] = min(doc, least.get(w, doc))
    out = []
    for doc, text in rows:
        raw = (text or "").encode()
        gone = [False] * len(raw)
        for p in range(len(raw) - WINDOW + 1):
            if doc is not None and least[raw[p: p + WINDOW]] < doc:
                gone[p: p + WINDOW] = [True] * WINDOW
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        out.append((doc, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def ran(spark, tmp_dir, rows, schema="doc_id long, text string"):
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_dir}/documents.parquet")
    return sorted((tuple(r) for r in S.op12_suffix_array_dedup(spark, tmp_dir).collect()), key=repr)


def words(rng, n):
    return " ".join(rng.choice(["the", "of", "añon", "rest", "in", "ça", "stable", "worthless", "1"]) for _ in range(n))


def test_against_brute_force(spark, tmp_dir):
    rng = random.Random(5)
    base = [words(rng, rng.choice([3, 8, 40, 160])) for _ in range(14)]
    rows = [(i, t) for i, t in enumerate(base)]
    passage = words(rng, 30)
    for i in range(14, 40):
        t = rng.choice(base)
        a, b = sorted((rng.randrange(len(t) + 1), rng.randrange(len(t) + 1)))
        rows.append((i, rng.choice([t, t[a:b], words(rng, 12) + t[a:b] + words(rng, 9), t[:a] + "#" + t[a:], passage + t, passage + passage])))
    # nulls, empty, short, repeated rows, one id on several texts, a run of one letter, ids out of order
    rows += [(50, None), (51, ""), (None, base[4]), (None, None), (52, "x" * 49), (53, "x" * 50), (54, "x" * 300), (55, "ab" * 100), (56, "ba" * 60),
             (2, base[2]), (3, base[7] + " " + base[8]), (60, passage), (60, passage), (-1, base[4][:90])]
    rng.shuffle(rows)
    assert ran(spark, tmp_dir, rows) == brute(rows)


def test_texts_longer_than_a_part(spark, tmp_dir):
    rng = random.Random(8)
    long = words(rng, 120_000)
    assert len(long.encode()) > S.PART + 10_000
    at = S.PART - 400        # the copy crosses the cut between two parts
    rows = [(1, long), (2, words(rng, 3000) + long[at - 30_000: at + 3000] + words(rng, 300)), (0, long[650:760])]
    assert ran(spark, tmp_dir, rows) == brute(rows)


@pytest.mark.parametrize("part", [120, 333, 5000])
def test_parts_hold_every_window_once(part, monkeypatch):
    monkeypatch.setattr(S, "PART", part)
    texts = [b"", None, bytes(range(200)) * 4, b"a" * 49, b"b" * 50, bytes(reversed(range(256))) * 3]
    seen = []
    for data, starts, numbers, offsets in S._parts(texts):
        ok = S._inside(starts, len(data))
        for k, number in enumerate(numbers.tolist()):
            for p in range(starts[k], starts[k + 1] - WINDOW + 1):
                assert ok[p]
                seen.append((number, p - starts[k] + offsets[k], data[p: p + WINDOW].tobytes()))
    want = [(i, p, t[p: p + WINDOW]) for i, t in enumerate(texts) if t for p in range(len(t) - WINDOW + 1)]
    assert sorted(seen) == want


def test_empty_table_and_clashing_columns(spark, tmp_dir):
    assert ran(spark, tmp_dir, []) == []
    rows = [(1, "y" * 60, 3, "k"), (2, "y" * 60, 4, "l")]
    got = ran(spark, f"{tmp_dir}/b", rows, "doc_id long, text string, rid long, `key` string")
    assert got == brute([r[:2] for r in rows])


def test_a_common_passage_in_every_row(spark, tmp_dir):
    rng = random.Random(2)
    passage = words(rng, 20)
    rows = [(i, f"{i} {rng.random()} {passage} {rng.random()}") for i in range(300)]
    assert ran(spark, tmp_dir, rows) == brute(rows)


@pytest.mark.parametrize("ranges", [1, 5])
def test_any_number_of_ranges(spark, tmp_dir, monkeypatch, ranges):
    """How buckets are dealt to ranges does not matter, nor how many blocks hold a bucket's members."""
    monkeypatch.setattr(S, "LEAST_RANGES", ranges)
    rng = random.Random(ranges)
    passage, other = words(rng, 40), words(rng, 60)
    rows = [(i, rng.choice([passage, other, passage + other, other[20:] + words(rng, 30) + passage[:90], words(rng, 50)])) for i in range(60)]
    assert ran(spark, tmp_dir, rows) == brute(rows)
