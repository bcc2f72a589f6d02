"""The registered queries and the pipeline."""

import duckdb
import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")
from lumenflow.llm.queries import ORACLES, QUERIES  # noqa: E402

corpus_pipeline = pytest.importorskip("corpus_pipeline")
DATA = "/root/testdata/sf0.001"
NAMED = {1: "documents", 2: "pages", 3: "documents", 4: "documents", 6: "documents", 8: "documents", 9: "documents"}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_rows_of_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "conversations", "embeddings", "benchmark", "pages"):
        db.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    want = db.execute(ORACLES[name]).df()
    got = QUERIES[name](spark, DATA).toPandas()
    cols = sorted(want.columns)
    assert cols == sorted(got.columns)
    plain = lambda df: sorted(map(str, df[cols].convert_dtypes().astype(str).itertuples(index=False)))
    assert plain(got) == plain(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_queries_run(spark, name):
    got = QUERIES[name](spark, DATA)
    n = int(name[2:].split("_")[0])
    if n in NAMED:
        assert got.count() == spark.read.parquet(f"{DATA}/{NAMED[n]}.parquet").count()
    else:
        assert got.count() > 0


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    extra = docs.withColumns({"lang_pred": F.lit(1), "lines": F.lit("x"), "kept": F.lit("y")})
    odd = extra.filter("doc_id < 3").withColumns({"doc_id": F.col("doc_id") + 10_000, "text": F.when(F.col("doc_id") == 10_000, None).otherwise("")})
    rows = extra.unionByName(odd).unionByName(extra.filter("doc_id = 5")).unionByName(extra.filter("doc_id = 7").withColumn("doc_id", F.lit(None).cast("long")))
    counts = [rows.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, rows, DATA)
        assert out.columns == rows.columns, name
        rows = out.cache()
        counts.append(rows.count())
    assert counts == sorted(counts, reverse=True) and counts[1] == counts[0] - 3
    assert rows.filter("doc_id = 5").count() <= 1
    packed = corpus_pipeline.STAGES[-1][1](spark, rows, DATA)
    assert packed.filter("start = 0").count() == rows.count()


def test_pipeline_of_an_empty_table(spark):
    rows = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        rows = stage(spark, rows, DATA)
        assert rows.count() == 0


def test_pipeline_runs(spark):
    assert corpus_pipeline.run(spark, DATA).count() > 0


def test_line_dedup_tells_carriers_from_copies(spark):
    banner = "We use cookies to give you the best experience on all of our many web pages ok"
    page = [f"line {k} of a page that many sites copy with number {k * 37}" for k in range(20)]
    rows = [(i, f"{banner}\nnews{i} of{i} the{i} town{i} and{i} more{i}", f"s{i}") for i in range(12)]
    rows += [(100 + i, "\n".join([*page, f"copied by site {i}"]), f"s{i}") for i in range(12)]
    rows += [(None, f"{banner}\nno id", "s1"), (300, banner, "s2"), (301, None, "s3")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, docs, DATA).collect()}
    assert all(got[i] == f"news{i} of{i} the{i} town{i} and{i} more{i}" for i in range(12))
    assert all(got[100 + i] == "\n".join([*page, f"copied by site {i}"]) for i in range(12))
    assert got[None] == "no id" and got[300] == banner and got[301] is None and len(got) == len(rows)


def test_language_id_without_labels_keeps_lettered_texts(spark):
    rows = [(1, "some text", None), (2, "123 ...", None), (3, None, None), (4, "漢字", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r.doc_id: r.lang for r in corpus_pipeline.language_id(spark, docs, DATA).collect()} == {1: None, 4: None}


def test_near_dedup_keeps_other_texts_of_a_doc_id(spark):
    words = [f"w{k}" for k in range(60)]
    base, other = " ".join(words), " ".join(f"o{k}" for k in range(40))
    rows = [(3, base), (5, other), (5, base + " x"), (7, base), (3, base + " y"), (3, base), (6, None), (6, None), (None, base)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, corpus_pipeline.near_dedup(spark, docs, DATA).collect()), key=str)
    assert len(got) == 4 and (5, other) in got and (6, None) in got and (None, base) in got
    assert sum(i == 3 and t.startswith(base) for i, t in got) == 1
