"""The prefix trie of conversations, level by level.

1. Turns are numbered within their conversation by ranges of (conversation, turn),
   so a conversation of any length is dealt out to many tasks. From here on a turn is
   a digest and a number of bytes; texts are shuffled once.
2. Conversations are rebuilt from the first turns of their base and the rest of
   their own. Rebuilt conversations that are equal form one class with a count.
3. Level-synchronous construction: at depth d the live classes are grouped by
   (parent node, next turn); a group's least conv_id names its node. Classes that
   share their node go on to the next depth; one that is alone has no more
   branches, so the rest of it, a chain, needs no level. So there are as many levels
   as the deepest turn that two different conversations share.
4. Chains know their leaf and their savings from running sums. Then the shared
   levels are gone through in reverse: the children of a level, summed up by parent,
   are joined to the level above.
5. Hashes of conv_ids: ids are sorted by ranges, joined to pieces there, and the
   pieces of a class are hashed one after the other in a stream.

Defined results: a null role or text counts as empty, a null turn comes first; turns
that tie are ordered by their digest. Turns that repeat all count. Rows without
conv_id belong to no conversation. A conversation whose rebuilt form has no turn is
a member of the root. Other columns are ignored. An empty table gives no rows, not
even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenflow.llm.common import Scratch, map_arrow, table
from lumenflow.llm.op12_resampling import CRC32, crc32_sql

#: Conversations of one base share its first turns; how many follows from a hash.
FAMILY, SHARED = 5, 9
#: Bytes of a piece of joined ids.
PIECE = 1 << 16
_NO_ENDS = hashlib.sha256(b"").hexdigest()


def digested(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, digest (of role and text), bytes (of the text)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    return conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"), F.octet_length(text).cast("long").alias("bytes"))


def numbered(turns: DataFrame, scratch: Scratch) -> DataFrame:
    """The turns with pos (from 1, within the conversation) and upto (bytes up to and with the turn).

    Ranges of the order are numbered on their own; a conversation that several
    ranges hold (no more than there are ranges) gets what lies before each.
    """
    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.asc_nulls_first("turn"), F.asc("digest")]
    dealt = scratch.stored(turns.repartitionByRange(n, "conv_id", *order).withColumn("range", F.spark_partition_id()), "ranges")
    held = dealt.groupBy("conv_id", "range").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("b"))
    split = held.groupBy("conv_id").agg(F.count(F.lit(1)).alias("ranges")).filter("ranges > 1").select("conv_id")
    above = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    before = held.join(F.broadcast(split), "conv_id").select("conv_id", "range", F.sum("n").over(above).alias("before_n"), F.sum("b").over(above).alias("before_b"))
    own = Window.partitionBy("range", "conv_id").orderBy(*order)
    rows = dealt.select("*", F.row_number().over(own).alias("pos"), F.sum("bytes").over(own.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"))
    rows = rows.join(F.broadcast(before), ["conv_id", "range"], "left")
    return rows.select("conv_id", "digest", "bytes", (F.col("pos") + F.coalesce("before_n", F.lit(0))).alias("pos"), (F.col("upto") + F.coalesce("before_b", F.lit(0))).alias("upto"))


def rebuilt(turns: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Conversations (conv_id, length), and their rebuilt turns (conv_id, depth, digest, bytes, rest: bytes from the turn on)."""
    heads = turns.filter(F.col("pos") < SHARED).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("pos", "digest", "bytes", "upto"))).alias("head"))
    convs = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("total"))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED
    convs = convs.join(heads, "conv_id").select("*", h.cast("int").alias("h"), (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base"))
    convs = convs.join(heads.select(F.col("conv_id").alias("base"), F.col("head").alias("lent")), "base", "left")
    last = lambda a: F.coalesce(F.try_element_at(a, F.lit(-1))["upto"], F.lit(0))
    first = lambda a: F.coalesce(F.slice(a, F.lit(1), F.col("h")), F.slice("head", 1, 0))
    convs = convs.select("conv_id", "n", "total", "h", first(F.col("lent")).alias("lent"), (F.col("total") - last(first(F.col("head")))).alias("own"))
    convs = convs.withColumn("length", F.size("lent") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    convs = scratch.stored(convs.withColumn("lent_bytes", last(F.col("lent"))), "conversations")
    lent = convs.select("conv_id", "own", "lent_bytes", F.explode("lent").alias("t"))
    lent = lent.select("conv_id", F.col("t.pos").alias("depth"), "t.digest", "t.bytes", (F.col("own") + F.col("lent_bytes") - F.col("t.upto") + F.col("t.bytes")).alias("rest"))
    own = turns.join(convs.select("conv_id", "h", "total", F.size("lent").alias("taken")), "conv_id").filter("pos > h")
    own = own.select("conv_id", (F.col("taken") + F.col("pos") - F.col("h")).alias("depth"), "digest", "bytes", (F.col("total") - F.col("upto") + F.col("bytes")).alias("rest"))
    return convs.select("conv_id", "length"), scratch.stored(lent.unionByName(own), "rebuilt")


def classes_of(convs: DataFrame, turns: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Classes of equal conversations (class_id: the least conv_id, length, n), and the members of those with n > 1 (class_id, conv_id)."""
    sign = lambda salt: F.bit_xor(F.xxhash64("depth", "digest", F.lit(salt)))
    signs = turns.groupBy("conv_id").agg(*[sign(k).alias(f"s{k}") for k in range(3)])
    signed = scratch.stored(convs.join(signs, "conv_id", "left").select("conv_id", "length", *[F.coalesce(f"s{k}", F.lit(0)).alias(f"s{k}") for k in range(3)]), "signed")
    key = ["length", "s0", "s1", "s2"]
    classes = scratch.stored(signed.groupBy(*key).agg(F.min("conv_id").alias("class_id"), F.count(F.lit(1)).alias("n")), "classes")
    return classes.select("class_id", "length", "n"), signed.join(classes.filter("n > 1"), key).select("class_id", "conv_id")


def joined_hashes(members: DataFrame) -> DataFrame:
    """class_id, ends: the SHA-256 of each class's conv_ids, ascending, comma-joined."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, first, ids, size = None, None, [], 0
        of = lambda: pa.RecordBatch.from_pydict({"class_id": [name], "first": [first], "piece": [",".join(ids)]})
        for batch in batches:
            for c, i in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if ids and (c != name or size > PIECE):
                    yield of()
                    ids, size = [], 0
                if not ids:
                    name, first = c, i
                ids.append(str(i))
                size += len(ids[-1]) + 1
        if ids:
            yield of()

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, state = None, None
        of = lambda: pa.RecordBatch.from_pydict({"class_id": [name], "ends": [state.hexdigest()]})
        for batch in batches:
            for c, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if state is not None and c == name:
                    state.update(b"," + piece.encode())
                    continue
                if state is not None:
                    yield of()
                name, state = c, hashlib.sha256(piece.encode())
        if state is not None:
            yield of()

    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = members.repartitionByRange(n, "class_id", "conv_id").sortWithinPartitions("class_id", "conv_id")
    joined = map_arrow(dealt, pieces, "class_id long, first long, piece string")
    return map_arrow(joined.repartition("class_id").sortWithinPartitions("class_id", "first").select("class_id", "piece"), hashes, "class_id long, ends string")


def _node(conv_id: Column | str, depth: Column, parent: Column, n: Column | str) -> list[Column]:
    conv_id, n = (F.col(x) if isinstance(x, str) else x for x in (conv_id, n))
    return [conv_id.alias("conv_id"), depth.cast("long").alias("depth"), parent.cast("long").alias("parent_conv_id"), n.alias("n_convs")]


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256: a row for each node."""
    kept, scratch = Scratch(conversations.sparkSession, "op13"), Scratch(conversations.sparkSession, "op13-work")
    convs, turns = rebuilt(scratch.stored(numbered(digested(conversations), scratch), "turns"), scratch)
    classes, members = classes_of(convs, turns, scratch)
    ends = classes.filter("n = 1").select("class_id", F.sha2(F.col("class_id").cast("string").cast("binary"), 256).alias("ends")).unionByName(joined_hashes(members))
    classes = scratch.stored(classes.join(ends, "class_id"), "ends")
    n = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = turns.withColumnRenamed("conv_id", "class_id").join(classes.select("class_id"), "class_id", "left_semi")
    turns = kept.stored(own.repartitionByRange(n, "depth", "class_id"), "turns")  # a level reads its own ranges

    root = classes.agg(F.min("class_id").alias("conv_id"), F.sum("n").alias("n")).filter("n is not null")
    root = root.select(*_node("conv_id", F.lit(0), F.lit(None), "n"), F.lit(0).cast("long").alias("bytes"))
    levels = [scratch.stored(root, "level")]
    live = classes.filter("length > 0").crossJoin(F.broadcast(levels[0].select(F.col("conv_id").alias("node"))))  # one row
    live, depth, alone, over = live.select("class_id", "node", "length", "n", "ends"), 0, [], [classes.filter("length = 0").crossJoin(F.broadcast(levels[0].select("conv_id"))).select("conv_id", F.lit(0).cast("long").alias("depth"), "ends")]
    while not live.isEmpty():
        depth += 1
        step = turns.filter(F.col("depth") == depth).join(live, "class_id")
        groups = step.groupBy("node", "digest").agg(F.min("class_id").alias("child"), F.sum("n").alias("n_convs"), F.count(F.lit(1)).alias("classes"), F.max("bytes").alias("bytes"))
        groups = scratch.stored(groups, "groups")
        shared = groups.filter("classes > 1")
        placed = scratch.stored(step.join(groups.select("node", "digest", "child", "classes"), ["node", "digest"]), "placed")
        alone.append(placed.filter("classes = 1").select("class_id", F.lit(depth).alias("since"), F.col("node").alias("parent"), "length", "n", "ends", "rest"))
        together = placed.filter("classes > 1")
        over.append(together.filter(F.col("length") == depth).select(F.col("child").alias("conv_id"), F.lit(depth).cast("long").alias("depth"), "ends"))
        levels.append(shared.select(*_node("child", F.lit(depth), F.col("node"), "n_convs"), "bytes"))
        live = together.filter(F.col("length") > depth).select("class_id", F.col("child").alias("node"), "length", "n", "ends")

    alone = kept.stored(reduce(DataFrame.unionByName, alone), "alone") if alone else None
    saved = (F.col("n") - 1) * F.col("rest")
    rolled, below = [], None
    for k in range(depth, -1, -1):
        level = levels[k]
        if alone is not None:
            tops = alone.filter(F.col("since") == k + 1).select(F.col("parent").alias("conv_id"), F.lit(1).cast("long").alias("leaves"), saved.alias("saved"))
            children = tops if below is None else tops.unionByName(below.select(F.col("parent_conv_id").alias("conv_id"), F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved")))
            sums = children.groupBy("conv_id").agg(F.count(F.lit(1)).alias("children"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
            level = level.join(sums, "conv_id", "left")
        else:
            level = level.select("*", *[F.lit(None).cast("long").alias(c) for c in ("children", "leaves", "saved")])
        level = level.select(
            "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("children", F.lit(0)).alias("n_children"), F.coalesce("leaves", F.lit(1)).alias("n_leaves"),
            ((F.col("n_convs") - 1) * F.col("bytes") + F.coalesce("saved", F.lit(0))).alias("saved_tokens"),
        )
        below = scratch.stored(level, "rolled")
        rolled.append(below)
    none = F.lit(_NO_ENDS)
    upper = reduce(DataFrame.unionByName, rolled).join(reduce(DataFrame.unionByName, over), ["conv_id", "depth"], "left").withColumn("ends_sha256", F.coalesce("ends", none)).drop("ends")
    upper = kept.stored(upper, "upper")
    scratch.drop()
    if alone is None:
        return upper
    chains = turns.join(alone.drop("rest"), "class_id").filter("depth >= since")
    chains = chains.select(
        *_node("class_id", F.col("depth"), F.when(F.col("depth") == F.col("since"), F.col("parent")).otherwise(F.col("class_id")), "n"),
        (F.col("length") > F.col("depth")).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), saved.alias("saved_tokens"),
        F.when(F.col("depth") == F.col("length"), F.col("ends")).otherwise(none).alias("ends_sha256"),
    )
    return upper.unionByName(chains)


def op13_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


_DIGEST = "sha256(length(role) || ':' || role || text)"
ORACLE = f"""
WITH RECURSIVE {CRC32},
o AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, {_DIGEST}) AS pos, {_DIGEST} AS digest, octet_length(encode(text))::BIGINT AS bytes
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
c AS (SELECT conv_id, conv_id - conv_id % {FAMILY} AS base, {crc32_sql("CAST(conv_id AS VARCHAR)")} % {SHARED} AS h FROM (SELECT DISTINCT conv_id FROM o), crc_table),
u AS (SELECT c.conv_id, 0 AS part, o.pos, o.digest, o.bytes FROM c JOIN o ON o.conv_id = c.base AND o.pos <= c.h
  UNION ALL SELECT c.conv_id, 1, o.pos, o.digest, o.bytes FROM c JOIN o ON o.conv_id = c.conv_id AND o.pos > c.h),
l AS (SELECT c.conv_id, coalesce(list(digest ORDER BY part, pos) FILTER (digest IS NOT NULL), []) AS seq, coalesce(list(bytes ORDER BY part, pos) FILTER (digest IS NOT NULL), []) AS size FROM c LEFT JOIN u USING (conv_id) GROUP BY c.conv_id),
m AS (SELECT conv_id, len(seq) AS length, d AS depth, list_slice(seq, 1, d) AS prefix, list_slice(seq, 1, d - 1) AS parent, CASE WHEN d > 0 THEN size[d] ELSE 0 END AS bytes FROM (SELECT *, unnest(range(len(seq) + 1)) AS d FROM l)),
n AS (SELECT depth, prefix, any_value(parent) AS parent, any_value(bytes) AS bytes, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(CASE WHEN length = depth THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '')) AS ends_sha256 FROM m GROUP BY depth, prefix),
k AS (SELECT depth - 1 AS depth, parent AS prefix, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1, 2),
w AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k ON k.depth = n.depth AND k.prefix = n.prefix),
a AS (SELECT list_slice(prefix, 1, d) AS prefix, sum((n_children = 0)::BIGINT)::BIGINT AS n_leaves, sum((n_convs - 1) * bytes)::BIGINT AS saved_tokens FROM (SELECT *, unnest(range(depth + 1)) AS d FROM w) GROUP BY 1)
SELECT w.conv_id, w.depth, p.conv_id AS parent_conv_id, w.n_convs, w.n_children, a.n_leaves, a.saved_tokens, w.ends_sha256
FROM w JOIN a ON a.prefix = w.prefix LEFT JOIN w p ON p.depth = w.depth - 1 AND p.prefix = w.parent
"""
