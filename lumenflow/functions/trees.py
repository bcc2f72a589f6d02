"""Block trees of any depth: recursive SQL over parent references, and a table function that flattens a tree."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from lumenflow.functions.documents import block_line, numbered

#: Levels of a tree; a deeper one fails the query rather than lose its blocks.
DEPTH = 100

_WALK = """
WITH RECURSIVE walk (doc_id, block_id, kind, path, seen, depth) MAX RECURSION LEVEL {depth} AS (
  SELECT doc_id, block_id, kind, place, array(block_id), 0 FROM {edges} WHERE parent_id IS NULL
  UNION ALL
  SELECT e.doc_id, e.block_id, e.kind, concat(w.path, '/', e.place), array_append(w.seen, e.block_id), w.depth + 1
  FROM walk w JOIN {edges} e ON e.doc_id = w.doc_id AND e.parent_id = w.block_id
  WHERE NOT array_contains(w.seen, e.block_id) AND w.kind NOT IN ('child_page', 'child_database'))
SELECT doc_id, block_id, path, depth FROM walk"""


def block_paths(blocks: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(doc_id, block_id, path, depth) of all blocks that can be reached from a root (a block without parent), by recursive SQL.

    A block occurs once for each way to it; a way never comes by a block twice, so
    a cycle ends where it closes. A block whose parent isn't there is not reached,
    nor are blocks inside a linked page or database. ``path`` orders the blocks of
    a document as they are read. The only columns that go through the recursion
    are keys. A tree of over ``depth`` levels fails.
    """
    spark = blocks.sparkSession
    edges = blocks.select("doc_id", F.col("block_id").cast("string").alias("block_id"), F.col("parent_id").cast("string").alias("parent_id"), F.col("type").alias("kind"), F.format_string("%08d", F.col("pos").cast("int")).alias("place"))
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")  # trees are as many as documents
    return spark.sql(_WALK.format(edges="{edges}", depth=depth), edges=edges)


def tree_markdown(blocks: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(doc_id, markdown) of block rows as ``documents.markdown`` takes them, of trees of any depth.

    A block that is listed more than once is shown wherever it is reached, with
    the content of its least position. Tables are not rendered here: their rows
    come as ordinary children. A document's lines meet in its one output row.
    """
    b = numbered(blocks).withColumn("block_id", F.col("block_id").cast("string"))
    row = F.struct(*[c for c in b.columns if c not in ("doc_id", "block_id")])
    own = b.groupBy("doc_id", "block_id").agg(F.min_by(row, "pos").alias("_b")).select("doc_id", "block_id", "_b.*")
    lines = block_paths(blocks, depth).join(own, ["doc_id", "block_id"])
    lines = lines.select("doc_id", "path", block_line(F.col("depth")).alias("line")).filter("line is not null")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "line"))), lambda s: s["line"]), "\n")
    return lines.groupBy("doc_id").agg(joined.alias("markdown"))


class FlattenTree:
    """The blocks of one partition (a document) in reading order, each with depth and path.

    ``analyze`` takes any table: columns named by the arguments ``id``, ``parent``
    and ``position`` (block_id, parent_id and pos by default) are looked up in it,
    the first partition column keeps its type, and all other columns are ignored.
    Cycles and missing parents are dealt with as in ``block_paths``. A partition's
    references (not its texts) are held by one task.
    """

    def __init__(self, *_: object, **__: object):
        self.children: dict[str | None, list[tuple[int, str]]] = {}

    @staticmethod
    def analyze(blocks: AnalyzeArgument, key: AnalyzeArgument, id: AnalyzeArgument | None = None, parent: AnalyzeArgument | None = None, position: AnalyzeArgument | None = None) -> AnalyzeResult:
        if not blocks.isTable:
            raise ValueError("the first argument is TABLE(…) PARTITION BY the document")
        names = {f.name: f.dataType for f in blocks.dataType.fields}
        wanted = [key.value, id.value if id else "block_id", parent.value if parent else "parent_id", position.value if position else "pos"]
        missing = [n for n in wanted if n not in names]
        if missing:
            raise ValueError(f"the table has no column {', '.join(missing)}")
        return AnalyzeResult(StructType().add(key.value, names[key.value]).add(wanted[1], StringType()).add("depth", IntegerType()).add("path", StringType()))

    def eval(self, blocks, key: str, id: str = "block_id", parent: str = "parent_id", position: str = "pos"):
        self.key = blocks[key]
        up = blocks[parent]
        self.children.setdefault(None if up is None else str(up), []).append((blocks[position], str(blocks[id])))

    def terminate(self):
        todo = [(c, 0, f"{p:08d}", (c,)) for p, c in sorted(self.children.get(None, []), reverse=True)]
        while todo:
            block, depth, path, seen = todo.pop()
            yield self.key, block, depth, path
            for p, c in sorted(self.children.get(block, []), reverse=True):
                if c not in seen:
                    todo.append((c, depth + 1, f"{path}/{p:08d}", (*seen, c)))


def register(spark: SparkSession, name: str = "flatten_tree") -> None:
    """Makes the table function known to SQL: ``SELECT * FROM flatten_tree(TABLE(t) PARTITION BY (doc_id), 'doc_id')``."""
    spark.udtf.register(name, udtf(FlattenTree))
