import glob
import os

from pyarrow.parquet import ParquetFile
from pyspark.sql import functions as F

from airexposure.llm import common, decontaminate


def test_row_groups_of_postings_are_bounded(spark):
    """A task holds a row group, so a partition's blocks of megabytes may not all go into one; a small first block changes nothing."""
    long = "array_join(transform(sequence(1, 300000), k -> concat(hex(k * 31 + id), lpad(k % 1000, 6, '0'))), ' ')"
    docs = spark.range(0, 14, 1, 1).select(F.col("id").alias("doc_id"), F.expr(f"CASE WHEN id = 0 THEN 'a b' ELSE {long} END").alias("text"))
    index = decontaminate.postings(docs)
    assert index.agg(F.sum(F.size("rows"))).head()[0] == 14
    files = [ParquetFile(f.removeprefix("file:")).metadata for f in index.inputFiles()]
    groups = [m.row_group(i) for m in files for i in range(m.num_row_groups)]
    assert sum(g.num_rows for g in groups) > 4
    assert max(g.total_byte_size for g in groups) <= 32 << 20
    items = spark.createDataFrame([("i", "A, b")], "item_id string, text string")
    hits = decontaminate.by_text(index, decontaminate.phrase_hits(index, items)).filter("size(hits) > 0").collect()
    assert [(r.row.doc_id, r.items) for r in hits] == [(0, ["i"])]


def test_the_stage_of_the_pipeline_bounds_its_row_groups(spark):
    """All of eleven blocks would be one row group, whatever their size."""
    docs = spark.range(0, 11, 1, 1).select("id", F.expr("CASE WHEN id = 3 THEN repeat('q ', 13) ELSE repeat(concat('w', id, ' '), 1500000) END").alias("text"))
    before = set(glob.glob(f"{common.scratch_dir(spark)}/postings-*"))
    items = spark.createDataFrame([("i", "q " * 13)], "item_id string, text string")
    assert sorted(r.id for r in decontaminate.drop_contaminated(docs, items).select("id").collect()) == [i for i in range(11) if i != 3]
    (made,) = set(glob.glob(f"{common.scratch_dir(spark)}/postings-*")) - before
    files = [ParquetFile(os.path.join(made, f)).metadata for f in os.listdir(made) if f.endswith(".parquet")]
    rows = [m.row_group(i).num_rows for m in files for i in range(m.num_row_groups)]
    assert sum(rows) >= 11 and max(rows) <= common.GROUP_ROWS
