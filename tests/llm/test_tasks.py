"""Work is spread over tasks: by rows and blocks, not by the few bytes of names."""

from pyspark.sql import functions as F

from tabreg.llm import token_counts, warc
from tabreg.llm.common import scratch_path, table

SF = "/root/testdata/sf0.001"


def places(df):
    return df.withColumn("task", F.spark_partition_id()).select("task").distinct().count()


def test_token_blocks_are_scanned_by_several_tasks(spark, monkeypatch):
    rows = token_counts.write_token_files(table(spark, SF, "documents"), scratch_path(spark, "t"))
    files = rows.where("ordinal IS NULL").select("file", "bytes")
    assert places(token_counts._scan_blocks(files, token_counts.END_OF_DOCUMENT, 200, 2)) > 4
    assert token_counts._scan_blocks(files.where("bytes < 0"), token_counts.END_OF_DOCUMENT, 200, 2).count() == 0


def test_archives_are_read_by_several_tasks(spark, monkeypatch):
    pages = table(spark, SF, "pages").repartition(9)
    files = warc.write_archives(pages, scratch_path(spark, "w"))
    assert files.count() > 4
    runs = warc.read_runs(files)
    assert places(runs) > 2
    monkeypatch.setattr(warc, "RANGE_ROWS", 7)
    captures = runs.count()
    merged = warc.merge_runs(runs).orderBy("position").collect()
    keys = [(r["url_key"], r["captured"]) for r in merged]
    assert len(merged) == captures and keys == sorted(keys) and [r["position"] for r in merged] == list(range(captures))
