"""Operator 7, n-gram Jaccard join: MinHash banding with verification on full n-gram sets.

A document's set holds its runs of ``WORDS`` normalised words. Documents of equal sets are one
class. Classes share a band if their MinHash rows in it are equal; bands are shuffled by their hash,
and bands and rows are chosen so that a pair at the threshold meets with probability ``RECALL``.
Classes joined by shared bands are verified together, in units of at most about ``UNIT_ROWS``
classes: larger sets are dealt into pairs of tiles. Where that would repeat the texts more often
(long chains), joined classes are verified band by band instead, a pair in the first band where it
meets, with tiles in the same way. Both ways link the same pairs: those at the threshold that share a band. Units recompute the full sets from the texts and return a row per
class (links, and the first class it is joined with), never pairs. Classes go by a written number
(``key``) and rows by id and text hash (``mark``), since an id may stand on several texts; ids are only
reported.

Defined results: texts without a word (null, empty) have no set and link with nothing; texts of
fewer than ``WORDS`` words have one n-gram, all their words; rows with a null id link with nothing
(null class, not kept apart); rows of equal sets are copies, whatever their ids; rows with equal ids but
different sets are rows like any others, each with its own class, links and decision; rows equal in id
and text share one decision; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, free_name, gram_hashes, hash_words, id_and_bytes, mix, normal_words, record_batch, table, written
from .components import connected_components, pair_roots, tile_count, tiles

WORDS = 5
THRESHOLD = 0.8
RECALL = 0.9999
MAX_ROWS = 128
UNIT_ROWS = 512
#: How often texts may be repeated in units by component, times that in units by band.
TOGETHER = 1.0
SEED = 17
BLOCK = 4096

_SKETCH = pa.schema([("doc_id", pa.int64()), ("mark", pa.int64()), ("print", pa.binary()), ("bands", pa.list_(pa.int64()))])
_LINKS = pa.schema([("key", pa.int64()), ("root", pa.int64()), ("links", pa.int64())])


def band_shape(threshold: float, recall: float, most: int = MAX_ROWS) -> tuple[int, int]:
    """Bands and rows a band: the most rows (fewest false candidates) whose bands for the recall at
    the threshold need at most ``most`` MinHash values."""
    best = (1, 1)
    for rows in range(1, most + 1):
        bands = math.ceil(math.log(1 - recall) / math.log1p(-(threshold**rows))) if threshold < 1 else 1
        if bands * rows > most:
            break
        best = (bands, rows)
    return best


def ngrams(text: bytes | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the text's n-grams."""
    h = hash_words(normal_words(text))
    return np.unique(gram_hashes(h, min(words, len(h)))) if len(h) else h


def fingerprint(grams: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(grams.tobytes())


def band_hashes(grams: np.ndarray, bands: int, rows: int, scale: np.ndarray, shift: np.ndarray) -> np.ndarray:
    least = np.full(bands * rows, np.iinfo(np.uint64).max, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for a in range(0, len(grams), BLOCK):
            part = grams[a: a + BLOCK, None] * scale + shift
            np.minimum(least, part.min(axis=0), out=least)
        parts = least.reshape(bands, rows)
        out = np.arange(1, bands + 1, dtype=np.uint64)
        for r in range(rows):
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) ^ parts[:, r])
    return out.view(np.int64)


def _marked(texts: DataFrame) -> DataFrame:
    """The rows with ``__mark``, a hash of the text: it tells rows of one id apart."""
    return texts.select("__id", F.xxhash64("__text").alias("__mark"), "__text")


def sketches(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """``doc_id, mark, print, bands`` of ``__id, __mark, __text`` rows (no print: no words)."""
    bands, rows = band_shape(threshold, recall)
    rng = np.random.default_rng(SEED)
    scale = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    shift = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches):
            prints, hashes = [], []
            for text in texts:
                grams = ngrams(text, words)
                prints.append(fingerprint(grams) if len(grams) else None)
                hashes.append(band_hashes(grams, bands, rows, scale, shift) if len(grams) else [])
            yield record_batch(_SKETCH, batch.column(0), batch.column(1), prints, hashes)

    return docs.mapInArrow(run, "doc_id long, mark long, print binary, bands array<long>")


def shared_grams(sets: list[np.ndarray]) -> np.ndarray:
    """How many n-grams each two sets share."""
    m = len(sets)
    sizes = [len(s) for s in sets]
    grams, place, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row, keep = np.repeat(np.arange(m), sizes), seen[place] > 1
    row, place = row[keep], np.cumsum(seen > 1)[place[keep]] - 1
    order = np.argsort(place, kind="stable")
    row, place = row[order], place[order]
    out, width = np.zeros((m, m)), 1 << 13
    edges = np.searchsorted(place, np.arange(0, (place[-1] + 1 if len(place) else 0) + width, width))
    for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        block = np.zeros((m, width), dtype=np.float32)
        block[row[a:b], place[a:b] - k * width] = 1
        out += block @ block.T
    return out


def _verified(units: DataFrame, words: int, threshold: float) -> DataFrame:
    """``key, root, links`` of the classes of each unit that have a link; rows come ordered by unit."""

    def unit(rows: list[dict]) -> tuple[list, list, list]:
        sets, own_rows, met = [], [], set()
        for r in rows:
            grams = ngrams(r["__text"], words)
            if r["key"] not in met and fingerprint(grams) == r["print"]:  # else a copy, or a text of equal id and hash
                met.add(r["key"])
                sets.append(grams)
                own_rows.append(r)
        rows = own_rows
        if len(rows) < 2:
            return [], [], []
        sizes = np.array([len(s) for s in sets])
        both = sizes[:, None] + sizes[None, :]
        shared = shared_grams(sets)
        i, j = np.nonzero(np.triu(shared >= threshold * (both - shared) - 1e-9, 1))
        # a pair is linked if it meets in a band, whichever way the unit came about; by bands, in its first one
        t, bands = rows[0]["t"], np.array([r["bands"] for r in rows])
        meet = bands[i] == bands[j]
        keep = meet.any(axis=1) if t < 0 else meet[:, t] & ~meet[:, :t].any(axis=1)
        if rows[0]["low"] != rows[0]["high"]:
            own = np.array([r["own"] for r in rows])
            keep &= own[i] != own[j]
        i, j = i[keep], j[keep]
        copies = np.array([r["copies"] for r in rows])
        links = np.bincount(i, copies[j], len(rows)) + np.bincount(j, copies[i], len(rows))
        root, at = pair_roots(len(rows), i, j), np.flatnonzero(links)
        keys = np.array([r["key"] for r in rows])
        return keys[at].tolist(), keys[root[at]].tolist(), links[at].astype(np.int64).tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []
        for batch in batches:
            for r in range(batch.num_rows):
                row = {n: c[r].as_py() for n, c in zip(batch.schema.names, batch.columns, strict=True)}
                k = (row["t"], row["bucket"], row["low"], row["high"])
                if k != key:
                    if len(rows) > 1:
                        yield record_batch(_LINKS, *unit(rows))
                    key, rows = k, []
                rows.append(row)
        if len(rows) > 1:
            yield record_batch(_LINKS, *unit(rows))

    return units.mapInArrow(run, "key long, root long, links long")


def _units(classes: DataFrame) -> DataFrame:
    """``key, t, bucket, low, high, own``: the units in which each candidate class is verified."""
    places = written(classes.select("key", F.posexplode("bands").alias("t", "bucket")), "band-rows")
    shared = places.groupBy("t", "bucket").agg(F.min("key").alias("first"), F.count("*").alias("size")).where("size > 1")
    members = written(places.join(written(shared, "shared-bands"), ["t", "bucket"]), "band-members")
    joined = connected_components(members.where("key <> first").select(F.col("key").alias("a"), F.col("first").alias("b")).distinct())
    sizes = written(joined.groupBy("component").agg(F.count("*").alias("joined")), "component-sizes")
    sized = written(joined.withColumnRenamed("node", "key").join(sizes, "component"), "joined-classes")
    # how often the texts would be repeated: by component, or by band
    rows = members.join(sized, "key").groupBy("component").agg(F.sum(tile_count(F.col("size"), UNIT_ROWS)).alias("by_band"))
    by_component = F.col("joined") * tile_count(F.col("joined"), UNIT_ROWS)
    chosen = written(sizes.join(rows, "component").select("component", (by_component <= F.col("by_band") * TOGETHER).alias("together")), "unit-choice")
    dealt = written(sized.join(chosen, "component"), "dealt-classes")
    together = dealt.where("together").select("key", F.lit(-1).alias("t"), F.col("component").alias("bucket"), F.explode(tiles(F.col("joined"), F.xxhash64("key"), UNIT_ROWS)).alias("u"))
    by_band = members.join(dealt.where("NOT together").select("key"), "key").select("key", "t", "bucket", F.explode(tiles(F.col("size"), F.xxhash64("key"), UNIT_ROWS)).alias("u"))
    return together.unionByName(by_band).select("key", "t", "bucket", "u.*")


def _decided(docs: DataFrame, id_col: str, text_col: str, words: int = WORDS, threshold: float = THRESHOLD,
             recall: float = RECALL) -> DataFrame:
    """The columns of ``jaccard_groups`` and ``mark``: rows that share id and mark are equal."""
    texts = _marked(id_and_bytes(docs, id_col, text_col))
    sketch = written(sketches(texts, words, threshold, recall), "sketches")
    usable = sketch.where("print IS NOT NULL AND doc_id IS NOT NULL")
    classes = usable.groupBy("print").agg(F.min(F.struct("doc_id", "mark")).alias("rep"), F.count("*").alias("copies"), F.first("bands").alias("bands"))
    classes = written(classes.withColumn("key", F.monotonically_increasing_id()), "classes")
    units = written(_units(classes), "verification-units")
    grouped = units.groupBy("key").agg(F.collect_list(F.struct("t", "bucket", "low", "high", "own")).alias("units"))
    candidates = written(classes.join(grouped, "key"), "candidates")
    loaded = texts.join(candidates, (F.col("__id") == F.col("rep.doc_id")) & (F.col("__mark") == F.col("rep.mark"))).select("key", "print", "copies", "bands", "__text", F.explode("units").alias("u"))
    flat = loaded.select("key", "print", "copies", "bands", "__text", "u.*")
    dealt = flat.repartition("t", "bucket", "low", "high").sortWithinPartitions("t", "bucket", "low", "high")
    found = written(_verified(dealt, words, threshold), "verified-links")

    groups = connected_components(found.where("key <> root").select(F.col("key").alias("a"), F.col("root").alias("b")))
    joined = groups.withColumnRenamed("node", "key")
    firsts = joined.join(classes.select("key", "rep"), "key").groupBy("component").agg(F.min("rep").alias("first"))
    joined = joined.join(firsts, "component").select("key", "first")
    links = found.groupBy("key").agg(F.sum("links").alias("links"))
    known = classes.select("print", "key", "rep", "copies").join(links, "key", "left").join(joined, "key", "left").select(
        "print", F.col("rep.doc_id").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("first", "rep").alias("first"))
    rows = sketch.select("doc_id", "mark", F.when(F.col("doc_id").isNotNull(), F.col("print")).alias("print"))
    return rows.join(written(known, "class-groups"), "print", "left").select(
        "doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("first.doc_id", "doc_id").alias("component_id"),
        (F.col("first").isNull() | (F.struct("doc_id", "mark") == F.col("first"))).alias("kept"), "mark")


def jaccard_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS,
                   threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """``doc_id, class_id, n_links, component_id, kept`` of every row: the smallest id with an equal
    set, the other documents linked directly, the smallest id reachable by links, and whether this
    is it (of several texts of that id, one)."""
    return _decided(docs, id_col, text_col, words, threshold, recall).drop("mark")


def without_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one document of each group: the smallest id, and one row of that id. Rows go by
    id and text, so other texts of an id that goes or stays are not touched."""
    groups = written(_decided(docs, id_col, text_col, **options), "groups")
    q = lambda c: F.col("`" + c.replace("`", "``") + "`")
    own, mark = free_name(docs, "__own"), free_name(docs, "__mark")
    other, other_mark = free_name(docs, "__other"), free_name(docs, "__other_mark")
    rows = docs.withColumn(own, q(id_col).cast("long")).withColumn(mark, F.xxhash64(q(text_col).cast("string").cast("binary")))
    same = (F.col(own) == F.col(other)) & (F.col(mark) == F.col(other_mark))
    named = [F.col("doc_id").alias(other), F.col("mark").alias(other_mark)]
    gone = groups.where(~F.col("kept")).select(*named).distinct()
    kept = rows.join(gone, same, "left_anti")
    again = groups.where("kept AND n_links > 0 AND doc_id IS NOT NULL").groupBy("doc_id", "mark").agg(F.count("*").alias("n"))
    again = written(again.where("n > 1").select(*named), "repeated-rows")
    if again.isEmpty():
        return kept.drop(own, mark)
    once = kept.join(again, same, "left_semi").dropDuplicates([own, mark])
    return kept.join(again, same, "left_anti").unionByName(once).drop(own, mark)


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(table(spark, sf_dir, "documents"))


QUERIES = {"op7_ngram_jaccard": op7_ngram_jaccard}
ORACLE_SQL = {"op7_ngram_jaccard": r"""
    WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
    g AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(words) < 5 THEN [array_to_string(words, ' ')] ELSE
        list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END)) AS grams FROM w WHERE len(words) > 0),
    c AS (SELECT min(doc_id) AS rep, count(*) AS copies, grams, len(grams) AS n FROM g GROUP BY grams),
    x AS (SELECT rep, n, copies, unnest(grams) AS gram FROM c),
    p AS (SELECT a.rep AS a, b.rep AS b, b.copies FROM x a JOIN x b ON a.gram = b.gram AND a.rep <> b.rep AND 5 * a.n >= 4 * b.n AND 5 * b.n >= 4 * a.n
          GROUP BY ALL HAVING 9 * count(*) >= 4 * (any_value(a.n) + any_value(b.n))),
    r AS (SELECT a AS node, a AS reach FROM p UNION SELECT r.node, p.b FROM r JOIN p ON p.a = r.reach),
    k AS (SELECT node, min(reach) AS component_id FROM r GROUP BY node),
    l AS (SELECT a, sum(copies) AS links FROM p GROUP BY a)
    SELECT d.doc_id, coalesce(rep, d.doc_id) AS class_id, CAST(coalesce(links, 0) + coalesce(copies, 1) - 1 AS BIGINT) AS n_links,
           coalesce(component_id, rep, d.doc_id) AS component_id, d.doc_id = coalesce(component_id, rep, d.doc_id) AS kept
    FROM documents d LEFT JOIN g USING (doc_id) LEFT JOIN c ON c.grams = g.grams LEFT JOIN k ON k.node = rep LEFT JOIN l ON l.a = rep"""}
