"""Operator 7 links the same pairs whether classes are verified by component or band by band."""

import numpy as np

from tabreg.llm import ngram_join as J


def test_links_do_not_depend_on_the_way(spark, monkeypatch):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(400)]
    base = [words[i] for i in rng.integers(0, 400, 120)]
    rows = []
    for i in range(60):      # a chain of near copies, each a few words further from the first
        rows.append((i, " ".join(base)))
        for _ in range(2):
            base[rng.integers(0, 120)] = words[rng.integers(0, 400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(J, "RECALL", 0.6)      # few bands, so that pairs above the threshold share none
    results, unmet = [], 0
    for together in (1e9, 0.0):
        monkeypatch.setattr(J, "TOGETHER", together)
        results.append(sorted(tuple(r) for r in J.jaccard_groups(docs, recall=0.6).collect()))
    sketch = {r["doc_id"]: r["bands"] for r in J.sketches(J._marked(J.id_and_bytes(docs, "doc_id", "text")), recall=0.6).collect()}
    sets = {i: set(J.ngrams(t.encode()).tolist()) for i, t in rows}
    links = dict.fromkeys(sets, 0)
    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
                if any(x == y for x, y in zip(sketch[a], sketch[b], strict=True)):
                    links[a] += 1
                    links[b] += 1
                else:
                    unmet += 1
    assert unmet > 0
    assert results[0] == results[1]
    assert {r[0]: r[2] for r in results[0]} == links
