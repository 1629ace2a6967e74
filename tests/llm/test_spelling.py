"""Operator 11 against brute force over all pairs of words."""

import random
import re
import zlib
from collections import Counter

from tabreg.llm import spelling as S

LOWER = {i: i + 32 for i in range(65, 91)}


def brute(rows):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))

    form, out = {}, []
    close = {w: [v for v in words if near(w, v)] for w in words}
    for w, n in words.items():
        best = min(close[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 10 * n else None
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(close[w]), form[w] and words[form[w]]))
    return sorted(out, key=repr)


def ran(spark, tmp_dir, rows, schema="doc_id long, text string"):
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_dir}/documents.parquet")
    return sorted((tuple(r) for r in S.op11_spelling_variants(spark, tmp_dir).collect()), key=repr)


def variants(rng, word):
    i, c = rng.randrange(len(word)), rng.choice("abeéßÿs")
    return rng.choice([word[:i] + word[i + 1:], word[:i] + c + word[i + 1:], word[:i] + c + word[i:], word[:i] + word[i] * 2 + word[i:], word])


def test_against_brute_force(spark, tmp_dir):
    rng = random.Random(4)
    base = ["document", "aaaaaaab", "Straßenbahn", "élèvement", "worthless", "ABABABAB", "mississippi", "ÀÉÎÕÜÝÿ", "zzzzzzzz"]
    rows = []
    for i in range(60):
        text = [rng.choice(base) for _ in range(30)] + [variants(rng, rng.choice(base)) for _ in range(25)]
        text += [variants(rng, variants(rng, rng.choice(base))) for _ in range(15)]
        rows.append((i, rng.choice([" ", "-", "Ā", "1", "\n"]).join(text)))
    rows += [(100, None), (101, ""), (None, "wordless wordless wordles1 wordles"), (None, None), (102, "short a b"), (3, rows[3][1]), (3, rows[4][1])]
    got = ran(spark, tmp_dir, rows)
    assert got == brute(rows)
    assert any(r[1] for r in got)


def test_chain_of_forms(spark, tmp_dir):
    chain = [("abcdefg", 2), ("abcdefgh", 25), ("abcdefghi", 300), ("abcdefghij", 3100)]
    rows = [(i, f"{w} ") for w, n in chain for i in range(n)]
    got = {r[0]: r for r in ran(spark, tmp_dir, rows)}
    assert sorted(got.values(), key=repr) == brute(rows)
    assert {got[w][2] for w, _ in chain if w in got} == {"abcdefghij"}


def test_ties_take_the_smallest_word(spark, tmp_dir):
    words = ["stablex", "stabley", "stablez", "stableà"]
    ids = [i for i in range(60) if all(zlib.crc32(f"{i}:{w}".encode()) % 31 for w in words)][:10]     # no letter goes
    rows = [(i, "stablex stablez stableà " * 7) for i in ids[1:]] + [(ids[0], "stabley stabley")]
    got = ran(spark, tmp_dir, rows)
    assert got == brute(rows)
    assert ("stabley", "stablex") in [(r[0], r[1]) for r in got]


def test_very_long_text_is_read_in_parts(monkeypatch):
    rng = random.Random(1)
    text = "".join(rng.choice(["Wordless", "é", " ", "-", "paragraph", "\n", "xyz"]) for _ in range(4000)) + "l" * 500
    whole = Counter(r.translate(LOWER) for r in re.findall("[A-Za-zÀ-ÿ]{7,}", text))
    for part in (1, 10, 999):
        monkeypatch.setattr(S, "PART", part)
        assert S.text_runs(text) == whole


def test_empty_table_and_clashing_columns(spark, tmp_dir):
    assert ran(spark, tmp_dir, []) == []
    rows = [(1, "wordless wordless", "w", 2), (1, "wordless wordlesss", "x", 3)]
    got = ran(spark, f"{tmp_dir}/b", rows, "doc_id long, text string, word string, n int")
    assert got == brute([r[:2] for r in rows])
