"""What a task holds of the count matrix doesn't grow with the texts it reads."""

import glob

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from lumenflow.llm import op12_resampling as op12
from lumenflow.llm.common import Scratch


def test_row_groups_of_few_blocks(spark, monkeypatch):
    seen, drop = {}, Scratch.drop

    def looked(self):
        for path in glob.glob(f"{self.path}/*/*.parquet"):
            file = pq.ParquetFile(path).metadata
            seen.setdefault(path.split("/")[-2], []).extend(file.row_group(k).num_rows for k in range(file.num_row_groups))
        drop(self)

    monkeypatch.setattr(Scratch, "drop", looked)
    monkeypatch.setattr(op12, "BLOCK", 1 << 12)  # a text each
    docs = spark.range(60, numPartitions=1).select(F.col("id").alias("doc_id"), F.repeat(F.concat(F.lit("word "), F.col("id").cast("string"), F.lit(" ")), 2_000).alias("text"))
    assert op12.resampled(docs, docs.select("text")).filter("n_words = 4000").count() == 60
    blocks = {k: n for k, n in seen.items() if k in ("001-matrix", "002-target")}
    assert len(blocks) == 2 and all(sum(n) == 60 and max(n) <= 4 for n in blocks.values())
