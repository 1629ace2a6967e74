"""An id on rows of different texts or vectors: each row has its own links, component and decision."""

import numpy as np
import pytest
from tabreg.llm import embeddings, ngram_join
from tabreg.llm.common import normal_words
from test_pairs import VECTORS, docs, groups_of, near_texts


def brute_rows(ids, linked):
    """By row: links, smallest id reachable, and the first row's number of its component."""
    n = len(ids)
    pairs = [(a, b) for a in range(n) for b in range(a) if linked(a, b)]
    root = groups_of(range(n), pairs)
    links = [sum(k in p for p in pairs) for k in range(n)]
    return links, [min(ids[j] for j in range(n) if root[j] == root[k]) for k in range(n)], root


def sets_of(rows):
    words = [normal_words(t.encode()) for _, t in rows]
    return [frozenset(tuple(w[i: i + 5]) for i in range(max(1, len(w) - 4))) for w in words]


@pytest.mark.parametrize(("unit", "bands"), [(512, False), (6, True)])
def test_ngram_join_repeated_ids(spark, monkeypatch, unit, bands):
    monkeypatch.setattr(ngram_join, "UNIT_ROWS", unit)
    if bands:
        monkeypatch.setattr(ngram_join, "tile_count", lambda size, limit: -size)
    texts = [t for _, t in near_texts(5) if t and len(t) > 20]
    rows = [(7 * k % 20, t) for k, t in enumerate(texts)]
    rows += [(5, "one text of its own that nothing is near to"), (5, "and a second one far from all of the others"),
             rows[0], rows[0], (rows[1][0], rows[1][1].upper())]
    sets = sets_of(rows)
    links, component, root = brute_rows([i for i, _ in rows], lambda a, b: 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]))
    classes = [min(i for (i, _), s in zip(rows, sets, strict=True) if s == own) for own in sets]
    frame = docs(spark, rows)
    got = sorted(tuple(r)[:4] for r in ngram_join.jaccard_groups(frame).collect())
    assert got == sorted(zip([i for i, _ in rows], classes, links, component, strict=True))

    kept = ngram_join.without_duplicates(frame)
    assert kept.columns == frame.columns
    left = [(r["doc_id"], r["text"]) for r in kept.collect()]
    at = {r: k for k, r in enumerate(rows)}
    assert sorted(root[at[r]] for r in left) == sorted(set(root.values()))    # one row of each group
    assert all(i == component[at[i, t]] for i, t in left)                     # of its smallest id


@pytest.mark.parametrize("unit", [8, 1024])
def test_embeddings_repeated_ids(spark, monkeypatch, unit):
    monkeypatch.setattr(embeddings, "UNIT_ROWS", unit)
    rng = np.random.default_rng(9)
    rows = []
    for c in range(6):
        centre = rng.standard_normal(16)
        for _ in range(8):
            rows.append((5 * len(rows) % 17, (centre + rng.standard_normal(16) * 0.12).astype(np.float32).tolist(), c % 3))
    rows += [(i, v, (lab + 1) % 3) for i, v, lab in rows[:12]]                # the same under another label
    rows += [(i, v[:4], lab) for i, v, lab in rows[:6]] + [rows[0], rows[0]]  # and of another length
    unit_vectors = [np.array(v) / np.linalg.norm(v) for _, v, _ in rows]
    links, component, root = brute_rows([i for i, _, _ in rows], lambda a, b: rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1])
                                        and unit_vectors[a] @ unit_vectors[b] >= 0.98 - 1e-12)
    out = embeddings.near_duplicates(spark.createDataFrame([(*r, "", "") for r in rows], VECTORS).repartition(3)).collect()
    assert sorted(tuple(r)[:3] for r in out) == sorted(zip([i for i, _, _ in rows], links, component, strict=True))
    assert sum(r["kept"] for r in out) == len(set(root.values())) + 2         # rows[0] stands there three times
    assert all(r["vec_id"] == r["component_id"] for r in out if r["kept"])
