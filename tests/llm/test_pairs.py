"""Embeddings, n-gram join, substrings, WARC, components, pipeline: brute force and edge cases."""

import base64
import hashlib
import math

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tabreg.llm import components, embeddings, ngram_join, substring_dedup, warc
from tabreg.llm.common import gram_hashes, hash_words, normal_words, plain_words, scratch_path, table, written

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, `__other` string, `a.b` string"


def docs(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, None, "s", 0, "clash", "dot") for i, t in rows], DOCS).repartition(parts)


def groups_of(nodes, pairs):
    root = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            low = min(root[a], root[b])
            if root[a] != low or root[b] != low:
                root[a] = root[b] = low
                changed = True
    return root


# ------------------------------------------------------------------ components

def test_components(spark):
    rng = np.random.default_rng(3)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (180, 2))] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5001 + i) for i in range(200)] + [(7, 7)]
    expected = groups_of({x for p in pairs for x in p}, pairs)
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {n: c for n, c in expected.items() if any(n in p and p[0] != p[1] for p in pairs)}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pair_roots():
    rng = np.random.default_rng(4)
    for _ in range(200):
        n = int(rng.integers(1, 40))
        i, j = rng.integers(0, n, (2, int(rng.integers(0, 40))))
        expected = groups_of(range(n), list(zip(i.tolist(), j.tolist(), strict=True)))
        assert components.pair_roots(n, i, j).tolist() == [expected[x] for x in range(n)]


def test_tiles_cover_each_pair_once(spark):
    rows = spark.range(50).select("id", F.explode(components.tiles(F.lit(50), F.xxhash64("id"), 10)).alias("u")).select("id", "u.*").collect()
    met = {}
    for a in rows:
        for b in rows:
            if a["id"] < b["id"] and (a["low"], a["high"]) == (b["low"], b["high"]) and (a["low"] == a["high"] or a["own"] != b["own"]):
                met[a["id"], b["id"]] = met.get((a["id"], b["id"]), 0) + 1
    assert len(met) == 50 * 49 // 2 and set(met.values()) == {1}


# ------------------------------------------------------------------ embeddings

VECTORS = "vec_id long, embedding array<float>, label int, rep string, bucket string"


def brute_vectors(rows):
    def usable(v, label, i):
        return label is not None and i is not None and v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)
    links = {k: 0 for k in range(len(rows))}
    pairs = []
    for a in range(len(rows)):
        for b in range(a):
            (i, v, lab), (j, w, lac) = rows[a], rows[b]
            if usable(v, lab, i) and usable(w, lac, j) and lab == lac and len(v) == len(w):
                x, y = np.array(v, float), np.array(w, float)
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.98 - 1e-12:
                    links[a] += 1
                    links[b] += 1
                    pairs.append((i, j))
    return links, groups_of({r[0] for r in rows if r[0] is not None}, pairs)


@pytest.mark.parametrize("unit", [8, 1024])
def test_embeddings(spark, monkeypatch, unit):
    monkeypatch.setattr(embeddings, "UNIT_ROWS", unit)
    rng = np.random.default_rng(6)
    rows = []
    for c in range(6):
        centre = rng.standard_normal(16)
        for _ in range(14):
            rows.append((len(rows), (centre + rng.standard_normal(16) * 0.12).astype(np.float32).tolist(), c % 3))
    rows += [(len(rows) + k, rows[0][1], 0) for k in range(5)] + [(900, rows[0][1], None), (901, None, 1), (902, [0.0] * 16, 1), (903, [float("nan")] + [1.0] * 15, 1),
             (904, [float("inf")] + [1.0] * 15, 1), (905, [None] + [1.0] * 15, 1), (906, [], 1), (907, [1.0, 0.0], 1), (908, [2.0, 0.0], 1), (None, rows[0][1], 0)]
    frame = spark.createDataFrame([(*r, "x", "y") for r in rows], VECTORS).repartition(3)
    got = {r["vec_id"]: r for r in embeddings.near_duplicates(frame).collect()}
    links, group = brute_vectors(rows)
    assert len(got) == len(rows)
    for k, (i, _, _) in enumerate(rows):
        assert got[i]["n_links"] == links[k], i
        assert got[i]["component_id"] == (group[i] if i is not None else None)
        assert got[i]["kept"] == (i is None or group[i] == i)


def test_embeddings_empty_and_repeated(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert embeddings.near_duplicates(empty).count() == 0
    twice = spark.createDataFrame([(1, [1.0, 2.0], 0, "", "")] * 2, VECTORS)
    assert [(r["n_links"], r["component_id"]) for r in embeddings.near_duplicates(twice).collect()] == [(1, 1), (1, 1)]


# ------------------------------------------------------------------ n-gram join

def near_texts(seed=1, words=60):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for base in range(12):
        text = [vocabulary[x] for x in rng.integers(0, 400, words)]
        for _ in range(5):
            copy = list(text)
            for _ in range(int(rng.integers(0, 4))):
                copy[int(rng.integers(0, words))] = vocabulary[int(rng.integers(0, 400))]
            rows.append((len(rows) + 10 * base, " ".join(copy)))
    return rows + [(900, None), (901, ""), (902, "?!"), (903, "a b"), (904, "A, b!"), (905, rows[0][1].upper() + "."), (906, "b a"), (None, rows[0][1])]


def brute_jaccard(rows):
    def grams(t):
        w = normal_words((t or "").encode())
        return frozenset(tuple(w[i: i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()
    sets = [(i, grams(t)) for i, t in rows]
    links, pairs = [0] * len(rows), []
    for a in range(len(rows)):
        for b in range(a):
            (i, s), (j, t) = sets[a], sets[b]
            if i is not None and j is not None and s and t and 10 * len(s & t) >= 8 * len(s | t):
                links[a] += 1
                links[b] += 1
                pairs.append((i, j))
    return links, groups_of({i for i, _ in rows if i is not None}, pairs)


@pytest.mark.parametrize(("unit", "bands"), [(2, False), (6, True), (2, True), (128, False)])
def test_ngram_join(spark, monkeypatch, unit, bands):
    monkeypatch.setattr(ngram_join, "UNIT_ROWS", unit)
    if bands:    # the way of long chains
        monkeypatch.setattr(ngram_join, "tile_count", lambda size, limit: -size)
    rows = near_texts()
    links, group = brute_jaccard(rows)
    got = {r["doc_id"]: r for r in ngram_join.jaccard_groups(docs(spark, rows)).collect()}
    assert len(got) == len(rows)
    for k, (i, _) in enumerate(rows):
        assert got[i]["n_links"] == links[k], (i, unit)
        assert got[i]["component_id"] == (group[i] if i is not None else None)


def test_without_duplicates(spark):
    rows = near_texts(2)
    _, group = brute_jaccard(rows)
    frame = docs(spark, [*rows, rows[0], rows[0], (901, "")])
    kept = ngram_join.without_duplicates(frame)
    assert kept.columns == frame.columns
    ids = [r["doc_id"] for r in kept.collect()]
    expected = [i for i, c in group.items() if i == c] + [901, None]
    assert sorted(map(str, ids)) == sorted(map(str, expected))
    assert ngram_join.without_duplicates(frame.limit(0)).count() == 0


def test_band_shape_and_shared_grams():
    for t in (0.5, 0.8, 0.9):
        bands, rows = ngram_join.band_shape(t, 0.9995)
        assert 1 - (1 - t**rows) ** bands >= 0.9995 and bands * rows <= ngram_join.MAX_ROWS
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 30_000, n).astype(np.uint64)) for n in (5, 9000, 9000, 1, 20_000)]
    assert ngram_join.shared_grams(sets).astype(int)[np.triu_indices(5, 1)].tolist() == [len(np.intersect1d(sets[i], sets[j])) for i, j in zip(*np.triu_indices(5, 1), strict=True)]


# ------------------------------------------------------------------ substrings

def brute_cut(rows, window):
    words = [plain_words((t or "").encode()) for _, t in rows]
    seen = {}
    for w in words:
        for i in range(len(w) - window + 1):
            seen[tuple(w[i: i + window])] = seen.get(tuple(w[i: i + window]), 0) + 1
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i: i + window])] > 1:
                gone |= set(range(i, i + window))
        out.append((len(w), len(gone), [x for i, x in enumerate(w) if i not in gone]))
    return out


@pytest.mark.parametrize(("window", "first"), [(8, 2), (8, 8), (5, 3), (1, 1)])
def test_substrings(spark, window, first, monkeypatch):
    rng = np.random.default_rng(window)
    rows = []
    for i in range(60):
        parts = ["".join(rng.choice(list("ab"), 2)) if i % 3 else f"u{rng.integers(0, 300)}" for _ in range(int(rng.integers(0, 60)))]
        if i % 4 == 0:
            parts[5:5] = [f"p{k}" for k in range(12)]
        rows.append((i, "\n ".join(parts)))
    rows += [(100, None), (101, ""), (102, " "), (103, "long " * 400), (104, rows[1][1]), (104, rows[1][1]), (None, rows[4][1]), (106, "x\x85y\xa0z " * 30)]
    expected = brute_cut(rows, window)
    frame = docs(spark, rows)
    cut = substring_dedup.cut_documents(frame, size_col="n_chars", window=window, first=first)
    assert cut.columns == frame.columns
    want = sorted((str(i), t if not n else b" ".join(k).decode()) for (i, t), (_, n, k) in zip(rows, expected, strict=True) if t is not None)
    assert sorted((str(r["doc_id"]), r["text"]) for r in cut.collect() if r["text"] is not None) == want
    monkeypatch.setattr(substring_dedup, "WINDOW", window)
    monkeypatch.setattr(substring_dedup, "table", lambda *_: frame)
    monkeypatch.setattr(substring_dedup.repeated_windows, "__defaults__", ("doc_id", "text", window, first))
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.op4_substring_dedup(spark, SF).collect())
    assert got == sorted((str(i), w, n, hashlib.sha256(b" ".join(k)).hexdigest()) for (i, _), (w, n, k) in zip(rows, expected, strict=True))


def test_substrings_empty(spark):
    assert substring_dedup.cut_documents(docs(spark, [(1, "a")]).limit(0)).count() == 0


def test_gram_hashes_and_anchors():
    rng = np.random.default_rng(1)
    for _ in range(100):
        words = [bytes([97 + x]) for x in rng.integers(0, 3, int(rng.integers(1, 70)))]
        h = hash_words(words)
        assert h.tolist() == [xxhash.xxh3_64_intdigest(w) for w in words]
        for k in (1, 2, 3, 5, 18, 35):
            names = {}
            for i, g in enumerate(gram_hashes(h, k).tolist()):
                assert names.setdefault(tuple(words[i: i + k]), g) == g
            assert len(set(names.values())) == len(names)
        for window, length in ((5, 3), (7, 4), (6, 1), (5, 5)):
            runs = gram_hashes(h, length).tolist()
            width = window - length + 1
            expected = {s + i for s in range(len(words) - window + 1) for i in range(width) if runs[s + i] == min(runs[s: s + width])}
            assert set(substring_dedup.anchors(h, window, length)[1].tolist()) == expected


# ------------------------------------------------------------------ WARC

PAGES = "page_id long, url string, html string, digest string, payload string"


def test_warc_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "READ_BYTES", 50)
    rows = [(1, "http://b.example/x", "same"), (2, "https://www.a.example/y?q=1#z", "same"), (3, None, None), (4, "http://a.example/\r\nX: y", ""), (5, "no url", "é" * 999),
            (6, "http://[bad", "same"), (7, "http://a.example/y", "q"), (7, "http://a.example/y", "q"), (None, "http://a.example/y", "alone"), (None, "u", "same"), (-3, "u%20v é", "\r\n\r\nWARC/1.1\r\n")]
    pages = spark.createDataFrame([(*r, "d", "p") for r in rows], PAGES).repartition(4)
    files = warc.write_archives(pages, scratch_path(spark, "w"), file_bytes=600)
    assert files.count() > 4 and files.agg(F.sum("records")).first()[0] == len(rows)
    got = warc.merge_runs(written(warc.read_runs(files), "r"), partitions=3).orderBy("position").collect()
    assert [r["position"] for r in got] == list(range(len(rows)))
    order = [(r["url_key"], r["captured"]) for r in got]
    assert order == sorted(order) and sorted(k for k, _ in order) == sorted(warc.url_key(u) for _, u, _ in rows)
    want = []
    for i, _, html in rows:
        payload = (html or "").encode()
        top = max((j for j, _, h in rows if (h or "") == (html or "") and j is not None), default=None)
        revisit = top is not None and i != top
        want.append((str(i), len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), "revisit" if revisit else "response", top if revisit else None))
    assert sorted((str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got) == sorted(want, key=str) or \
        sorted(map(str, want)) == sorted(str((str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"])) for r in got)


def test_warc_empty(spark):
    files = warc.write_archives(spark.createDataFrame([], PAGES), scratch_path(spark, "w"))
    assert files.count() == 0 and warc.merge_runs(written(warc.read_runs(files), "r")).count() == 0


def test_loser_tree():
    rng = np.random.default_rng(2)
    for _ in range(300):
        runs = [sorted(rng.integers(0, 9, int(rng.integers(0, 6))).tolist()) for _ in range(int(rng.integers(1, 10)))]
        heads, out = [0] * len(runs), []
        for r in warc.loser_tree(runs):
            out.append(runs[r][heads[r]])
            heads[r] += 1
        assert out == sorted(x for r in runs for x in r)


# ------------------------------------------------------------------ pipeline and registry

def test_pipeline(spark):
    import corpus_pipeline as pipeline
    from tabreg.llm import decontamination, packing, quality

    names = [n for n, _ in pipeline.STAGES]
    assert names == ["quality", "near_duplicates", "substrings", "decontamination", "packing"]
    frame = table(spark, SF, "documents").withColumn("a.b", F.lit(1)).withColumn("__score", F.lit(2))
    frame = written(frame.unionByName(spark.createDataFrame([(-1, None, None, None, None, 1, 2), (-2, "", None, None, 0, 1, 2)], frame.schema)).toDF(*frame.columns), "in")
    at = frame
    for name, stage in pipeline.STAGES[:-1]:
        after = written(stage(spark, at, SF), name)
        assert after.columns == frame.columns
        before, rows = at.collect(), after.collect()
        ids = sorted(r["doc_id"] for r in rows)
        if name == "quality":
            scored = quality.score(at, quality.learn(at, table(spark, SF, "labels")), name="score").collect()
            assert ids == sorted(r["doc_id"] for r in scored if r["score"] >= quality.THRESHOLD) and 0 < len(ids) < len(before)
        elif name == "near_duplicates":
            _, group = brute_jaccard([(r["doc_id"], r["text"]) for r in before])
            assert ids == sorted(i for i, c in group.items() if i == c) and len(ids) < len(before)
        elif name == "substrings":
            cut = brute_cut([(r["doc_id"], r["text"]) for r in before], 35)
            texts = {r["doc_id"]: (r["text"], r["n_chars"]) for r in rows}
            for r, (_, n, kept) in zip(before, cut, strict=True):
                text = b" ".join(kept).decode() if n else r["text"]
                assert texts[r["doc_id"]] == (text, len(text) if n else r["n_chars"])
        else:
            found = decontamination.find_items(at, decontamination.automata(table(spark, SF, "benchmark"))).collect()
            assert ids == sorted(r["doc_id"] for r in found if not (r["n_hit"] and 20 * r["n_hit"] >= r["n_words"])) and len(ids) < len(before)
        at = after
    pieces = pipeline.STAGES[-1][1](spark, at, SF).collect()
    assert {p["doc_id"] for p in pieces} == {r["doc_id"] for r in at.collect()} and all(len(p["ids"]) == 4 * p["length"] for p in pieces)
    assert packing.SEPARATOR == 2 and sorted(p["sequence_id"] for p in pieces)[0] == 0


def test_pipeline_empty_table(spark):
    import corpus_pipeline as pipeline

    at = table(spark, SF, "documents").limit(0)
    for _, stage in pipeline.STAGES:
        at = written(stage(spark, at, SF), "empty")
    assert at.count() == 0


def test_registry():
    from tabreg.llm import registry

    assert sorted(int(n[2:].split("_")[0]) for n in registry.queries()) == list(range(1, 11))
    assert set(registry.oracle_sql()) <= set(registry.queries())
