"""Block trees of any depth by recursive SQL and by the table function."""

import pytest

from lumenflow.functions import documents as D
from lumenflow.functions import trees as T

SCHEMA = "doc_id string, block_id string, parent_id string, pos int, type string, text string, checked boolean, language string, title string, url string, cells array<string>"


def block(doc, name, parent, pos, kind="paragraph", text=None):
    return (doc, name, parent, pos, kind, text if text is not None else name, False, None, None, None, None)


def forest(spark):
    rows = [block("deep", f"n{k}", f"n{k - 1}" if k else None, 0, "bulleted_list_item") for k in range(30)]
    rows += [block("wide", "r", None, 0, "heading_1")] + [block("wide", f"c{k}", "r", k, "numbered_list_item") for k in range(12)]
    rows += [block("wide", "c3x", "c3", 0), block("wide", "lost", "nobody", 0), block("wide", "lost2", "lost", 0)]
    # a block inside itself by way of its child, and two blocks that only hold each other
    rows += [block("ring", "a", None, 0), block("ring", "b", "a", 0), block("ring", "c", "b", 0), block("ring", "a", "c", 0), block("ring", "x", "y", 0), block("ring", "y", "x", 0)]
    rows += [block("page", "p", None, 0, "child_page"), block("page", "inside", "p", 0), block("page", "after", None, 1)]
    return spark.createDataFrame(rows, SCHEMA)


def test_paths_of_any_depth(spark):
    got = {}
    for r in T.block_paths(forest(spark)).orderBy("doc_id", "path").collect():
        got.setdefault(r.doc_id, []).append((r.block_id, r.depth))
    assert got["deep"] == [(f"n{k}", k) for k in range(30)]
    assert got["wide"] == [("r", 0), *[x for k in range(12) for x in ([(f"c{k}", 1), ("c3x", 2)] if k == 3 else [(f"c{k}", 1)])]]
    assert got["ring"] == [("a", 0), ("b", 1), ("c", 2)]
    assert got["page"] == [("p", 0), ("after", 0)]


def test_deeper_than_the_bound_fails(spark):
    with pytest.raises(Exception, match="(?i)recursion"):
        T.block_paths(forest(spark), 10).collect()


def test_tree_markdown_equals_the_bounded_one(spark):
    df = forest(spark).filter("doc_id = 'wide'")
    assert T.tree_markdown(df).collect() == D.markdown(df, 5).collect()
    deep = T.tree_markdown(forest(spark).filter("doc_id = 'deep'")).first().markdown.split("\n")
    assert deep == ["  " * k + f"- n{k}" for k in range(30)]
    assert T.tree_markdown(forest(spark).limit(0)).count() == 0


def test_table_function(spark):
    T.register(spark)
    df = forest(spark).filter("doc_id <> 'page'")
    df.createOrReplaceTempView("forest_blocks")
    got = spark.sql("SELECT * FROM flatten_tree(TABLE(forest_blocks) PARTITION BY (doc_id), 'doc_id')")
    assert got.columns == ["doc_id", "block_id", "depth", "path"]
    cols = ["doc_id", "block_id", "depth", "path"]
    assert sorted(got.select(cols).collect()) == sorted(T.block_paths(df).select(cols).collect())
    renamed = df.selectExpr("length(doc_id) AS doc", "block_id AS id", "parent_id AS up", "pos AS place", "'x' AS depth")
    renamed.createOrReplaceTempView("renamed_blocks")
    other = spark.sql("SELECT * FROM flatten_tree(TABLE(renamed_blocks) PARTITION BY (doc), 'doc', 'id', 'up', 'place')")
    assert dict(other.dtypes) == {"doc": "int", "id": "string", "depth": "int", "path": "string"}
    with pytest.raises(Exception, match="no column"):
        spark.sql("SELECT * FROM flatten_tree(TABLE(renamed_blocks) PARTITION BY (doc), 'doc')").collect()
