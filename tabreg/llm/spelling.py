"""Operator 11, spelling variants: permuterm rotations.

Words are counted over all texts first (partial counts in each task). Then every word is marked with an
end (``$``) and rotated: a word ``a c b`` gives, for each of its letters ``c``, the rotation ``b $ a c``;
two words that differ in that letter alone have rotations with the same prefix ``b $ a``, and the
word without the letter is that prefix itself, as a whole rotation. So near words are neighbours
among the sorted rotations: a group is the range of one prefix, whose last letter is skipped.

A group holds one rotation a letter of the alphabet (91 letters) and the whole rotation at most, however
frequent its words are, so no group is hot. Rotations are dealt by their prefix, sorted inside partitions, and
a scan over each group gives every member the number of its neighbours and the best of them: what
is emitted grows with the rotations, not with pairs. A word with a run of equal letters meets the word
without one of them once for each; only the first of the run counts.

A form has at least ten times the count of its word, so chains of forms end, after 18 steps at most;
roots are found by doubling: five rounds, fewer if nothing changes.

Defined results: null and empty texts have no words; a null id counts as an empty one in the
checksum; repeated rows count again; equal counts of near words: smallest in code-point order;
an empty table gives no rows; other columns are not read. A very long text is read in parts, cut between
runs.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, id_and_bytes, record_batch, table, written

LEAST_LETTERS, LEAST_COUNT, RATIO, DELETED = 7, 2, 10, 31
#: Different words that a task counts before it passes them on, and characters read at a time.
TASK_WORDS, PART = 500_000, 1 << 20
END = "$"

_LOWER = {i: i + 32 for i in range(65, 91)}
_RUN = re.compile(f"[a-zÀ-ÿ]{{{LEAST_LETTERS},}}")
_BETWEEN = re.compile("[^a-zÀ-ÿ]")
_COUNTS = pa.schema([("word", pa.string()), ("n", pa.int64())])


def text_runs(text: str) -> Counter:
    """The lower-cased runs of enough letters, with their counts."""
    plain, found, a = text.translate(_LOWER), Counter(), 0
    while a < len(plain):
        cut = _BETWEEN.search(plain, a + PART)
        b = cut.start() if cut else len(plain)
        found.update(_RUN.findall(plain, a, b))
        a = b
    return found


def shortened(doc: str, run: str) -> str:
    """The run without one letter, if its checksum with the document says so."""
    h = zlib.crc32(f"{doc}:{run}".encode())
    if h % DELETED:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word, n`` of the words with enough letters and occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch, found in chunks(batches):
            for doc, text in zip(batch.column(0).to_pylist(), found, strict=True):
                if not text:
                    continue
                name = "" if doc is None else str(doc)
                for r, n in text_runs(text.decode("utf-8", "replace")).items():
                    word = shortened(name, r)
                    if len(word) >= LEAST_LETTERS:
                        total[word] += n
            if len(total) > TASK_WORDS:
                yield record_batch(_COUNTS, list(total), list(total.values()))
                total = Counter()
        yield record_batch(_COUNTS, list(total), list(total.values()))

    counted = id_and_bytes(docs, id_col, text_col).mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def rotations(words: DataFrame) -> DataFrame:
    """``prefix, letter, n``: the rotations of the marked words; ``letter`` is the last one, null for a
    whole rotation (the word is what a letter more would make of it, without the letter)."""
    w, size = F.col("word"), F.length("word")
    places = F.sequence(F.lit(1), size + 1)
    without = F.transform(F.slice(places, F.lit(1), size), lambda i: F.struct(
        F.concat(F.substring(w, i + 1, size), F.lit(END), F.substring(w, F.lit(1), i - 1)).alias("prefix"), F.substring(w, i, F.lit(1)).alias("letter")))
    whole = F.transform(places, lambda i: F.struct(
        F.concat(F.substring(w, i, size), F.lit(END), F.substring(w, F.lit(1), i - 1)).alias("prefix"), F.lit(None).cast("string").alias("letter")))
    return words.select(F.explode(F.concat(without, whole)).alias("r"), "n").select("r.*", "n")


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted rotations, each word of a group of several with its neighbours there: their number
    and the best one, larger count first, then smaller word."""
    schema = pa.schema([("word", pa.string()), ("near", pa.int64()), ("best", pa.string()), ("best_n", pa.int64())])
    out: list[tuple] = []

    def close(prefix: str, members: list[tuple[str | None, int]]) -> None:
        b, a = prefix.split(END)
        letters = [(-n, a + c + b, c) for c, n in members if c is not None]
        whole = next(((-n, a + b) for c, n in members if c is None), None)
        letters.sort()
        # the letter after its like says nothing new of the word without it
        first = [x for x in letters if not a.endswith(x[2])]
        for x in letters:
            near = [y for y in letters[:2] if y is not x][:1]
            count = len(letters) - 1
            if whole and not a.endswith(x[2]):
                near, count = near + [whole], count + 1
            if count:
                best = min(near)
                out.append((x[1], count, best[1], -best[0]))
        if whole and first:
            out.append((whole[1], len(first), first[0][1], -first[0][0]))

    held, members = None, []
    for batch in batches:
        prefixes, letters, counts = (batch.column(i).to_pylist() for i in range(3))
        for prefix, letter, n in zip(prefixes, letters, counts, strict=True):
            if prefix != held:
                if len(members) > 1:
                    close(held, members)
                held, members = prefix, []
            members.append((letter, n))
        yield record_batch(schema, *([r[i] for r in out] for i in range(4)))
        out.clear()
    if len(members) > 1:
        close(held, members)
    yield record_batch(schema, *([r[i] for r in out] for i in range(4)))


def near_words(words: DataFrame) -> DataFrame:
    """``word, n_near, form, form_n`` of the words with near ones: how many, and the best of them."""
    dealt = rotations(words).repartition("prefix").sortWithinPartitions("prefix")
    scanned = dealt.mapInArrow(_scan, "word string, near long, best string, best_n long")
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("word")))
    found = scanned.groupBy("word").agg(F.sum("near").alias("n_near"), best.alias("best"))
    return found.select("word", "n_near", F.col("best.word").alias("form"), (-F.col("best.less")).alias("form_n"))


def _roots(forms: DataFrame) -> DataFrame:
    """``word, root`` for ``word, form`` rows: the last of the chain of forms."""
    at = written(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        further = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        at = written(at.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        moved = not at.where("moved").isEmpty()
        at = at.select("word", "root")
        if not moved:
            return at


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    words = written(word_counts(docs, id_col, text_col), "spelling-words")
    near = words.join(near_words(words), "word", "left")
    frequent = F.col("form_n") >= RATIO * F.col("n")
    near = near.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                       F.when(frequent, F.col("form")).alias("form"), F.when(frequent, F.col("form_n")).alias("form_n"))
    near = written(near, "spelling-near")
    roots = _roots(near.where("form IS NOT NULL"))
    return near.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


QUERIES = {"op11_spelling_variants": op11_spelling_variants}
# DuckDB has no crc32: its table of 256 entries is made by the rule of the polynomial 0xEDB88320.
_STEP = "CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END"
ORACLE_SQL = {"op11_spelling_variants": rf"""
    WITH RECURSIVE s AS (SELECT i, i AS x, 0 AS k FROM (SELECT unnest(range(0, 256)) AS i)
                         UNION ALL SELECT i, {_STEP}, k + 1 FROM s WHERE k < 8),
    crc AS MATERIALIZED (SELECT list(x ORDER BY i) AS t FROM s WHERE k = 8),
    r AS MATERIALIZED (SELECT doc_id, run, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(
            translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')) AS run FROM documents)
          WHERE length(run) >= {LEAST_LETTERS} GROUP BY ALL),
    b AS (SELECT doc_id, run, n, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS x FROM r),
    h AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, length(x) // 2),
              lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT))),
              lambda a, c: xor(a >> 8, t[(xor(a, c) & 255) + 1])), 4294967295) AS h FROM b, crc),
    v AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
            SELECT CASE WHEN h % {DELETED} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM h)
          WHERE length(word) >= {LEAST_LETTERS} GROUP BY word HAVING sum(n) >= {LEAST_COUNT}),
    g AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
    e AS (SELECT DISTINCT a.word, b.word AS near, b.n FROM g a JOIN g b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
          UNION SELECT g.word, v.word, v.n FROM g JOIN v ON g.rest = v.word
          UNION SELECT v.word, g.word, g.n FROM g JOIN v ON g.rest = v.word),
    m AS (SELECT word, count(*) AS n_near, arg_min(near, (-n, encode(near))) AS form, max(n) AS form_n FROM e GROUP BY word),
    f AS MATERIALIZED (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= {RATIO} * v.n THEN form END AS form,
                 CASE WHEN form_n >= {RATIO} * v.n THEN form_n END AS form_n FROM v LEFT JOIN m USING (word)),
    c AS (SELECT word, form AS last, 1 AS k FROM f WHERE form IS NOT NULL
          UNION ALL SELECT c.word, f.form, k + 1 FROM c JOIN f ON f.word = c.last WHERE f.form IS NOT NULL),
    z AS (SELECT word, arg_max(last, k) AS root FROM c GROUP BY word)
    SELECT word, form, coalesce(root, word) AS root, n, n_near, form_n FROM f LEFT JOIN z USING (word)"""}
