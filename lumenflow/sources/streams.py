"""Streaming data sources in Python: a sink of result messages that commits by batch, and a cursor-paged API as an incremental source."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, DataSourceStreamWriter, InputPartition, WriterCommitMessage


class FolderStore:
    """Objects in a folder that driver and executors share; another store has the same three methods."""

    def __init__(self, root: str):
        self.root = root

    def put(self, key: str, content: bytes) -> None:
        path = f"{self.root}/{key}"
        os.makedirs(os.path.dirname(path), exist_ok=True)
        part = f"{os.path.dirname(path)}/.{uuid.uuid4().hex}"
        with open(part, "wb") as f:
            f.write(content)
        os.replace(part, path)  # whole or not at all

    def exists(self, key: str) -> bool:
        return os.path.exists(f"{self.root}/{key}")

    def delete(self, key: str) -> None:
        if self.exists(key):
            os.remove(f"{self.root}/{key}")


@dataclass
class Written(WriterCommitMessage):
    """The object of one task, and how many messages it holds."""

    key: str | None
    messages: int


class MessageWriter(DataSourceStreamWriter):
    """Tasks write objects that nobody reads; a batch is published by one manifest that names its objects.

    A task that fails leaves at most an object without manifest. A batch that is
    written again after its commit finds its manifest and publishes nothing.
    """

    def __init__(self, store: Callable[[str], FolderStore], path: str, size: int):
        self.store, self.path, self.size = store, path, size

    def write(self, iterator: Iterator) -> Written:
        lines, key = [], f"messages/{uuid.uuid4().hex}.json"
        for row in iterator:
            body = row["body"]
            if body is not None and len(body.encode()) > self.size:
                raise ValueError(f"a message of over {self.size} bytes")
            lines.append(json.dumps(row.asDict(), ensure_ascii=False))
        if not lines:
            return Written(None, 0)
        self.store(self.path).put(key, ("\n".join(lines) + "\n").encode())
        return Written(key, len(lines))

    def commit(self, messages: list, batchId: int) -> None:
        store, manifest = self.store(self.path), f"manifests/{batchId:012d}.json"
        written = [m for m in messages if m is not None and m.key]
        if store.exists(manifest):
            for m in written:
                store.delete(m.key)
            return
        rows = [{"batch_id": batchId, "file": m.key.rpartition("/")[2], "messages": m.messages} for m in written]
        store.put(manifest, "".join(json.dumps(r) + "\n" for r in rows).encode())

    def abort(self, messages: list, batchId: int) -> None:
        store = self.store(self.path)
        for m in messages:
            if m is not None and m.key:
                store.delete(m.key)


def message_sink(name: str, store: Callable[[str], FolderStore] = FolderStore, size: int = 256_000) -> type[DataSource]:
    """A streaming sink of result messages (any columns, with ``body``); option ``path``. A message over ``size`` bytes fails its batch."""

    class Messages(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return "gallery_id long, chunk long, body string"

        def streamWriter(self, schema, overwrite: bool) -> DataSourceStreamWriter:
            return MessageWriter(store, self.options["path"], size)

    return Messages


def published(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The messages of all batches that are committed, with batch_id."""
    manifests = spark.read.schema("batch_id long, file string, messages long").json(f"{path}/manifests")
    rows = spark.read.schema(schema).json(f"{path}/messages").withColumn("file", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))
    return rows.join(manifests.select("batch_id", "file"), "file").drop("file")


#: (rows, the next cursor or None) of a page.
Fetch = Callable[[str, str | None], tuple[list[str], str | None]]


class CursorRange(InputPartition):
    """Pages of one collection: from a place (cursor, rows of that page read already) to another."""

    def __init__(self, collection: str, start: list, end: list):
        super().__init__((collection, start, end))
        self.collection, self.start, self.end = collection, start, end


class CursorReader(DataSourceStreamReader):
    """An offset holds a place in each collection: the cursor of a page, and how many of its rows are read.

    Pages only get longer or are added at the end. Every collection is a partition
    of its own; a batch takes at most ``pages`` new pages of each.
    """

    def __init__(self, fetch: Fetch, collections: list[str], pages: int):
        self.fetch, self.collections, self.pages = fetch, collections, pages
        self.seen = self.initialOffset()

    def initialOffset(self) -> dict:
        return {c: [None, 0] for c in self.collections}

    def latestOffset(self) -> dict:
        """Follows the cursors from the last known places; of a page only its length is kept."""
        out = {}
        for c in self.collections:
            cursor, n = self.seen[c]
            for _ in range(self.pages):
                rows, following = self.fetch(c, cursor)
                n = max(n, len(rows))
                if following is None:
                    break
                cursor, n = following, 0
            out[c] = [cursor, n]
        self.seen = out
        return out

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        for c in self.collections:  # after a restart the engine knows more than a new reader
            if self.seen[c] == [None, 0]:
                self.seen[c] = end.get(c, [None, 0])
        return [CursorRange(c, start.get(c, [None, 0]), end[c]) for c in end if end[c] != start.get(c, [None, 0])]

    def read(self, partition: CursorRange) -> Iterator[tuple]:
        (cursor, begin), (last, until) = partition.start, partition.end
        while True:
            rows, following = self.fetch(partition.collection, cursor)
            stop = until if cursor == last else len(rows)
            for pos in range(begin, stop):
                yield partition.collection, cursor or "", pos, rows[pos]
            if cursor == last or following is None:
                return
            cursor, begin = following, 0

    def commit(self, end: dict) -> None:
        pass

    def stop(self) -> None:
        pass


def cursor_source(name: str, fetch: Fetch) -> type[DataSource]:
    """A streaming source of a cursor-paged API: rows (collection, cursor, pos, body), each once.

    ``fetch(collection, cursor)`` gives a page's JSON rows and the next cursor (None
    at the end). Options: ``collections`` (comma-separated) and ``maxpages``, the
    new pages of a collection that a batch takes (100).
    """

    class Cursors(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return "collection string, cursor string, pos int, body string"

        def streamReader(self, schema) -> DataSourceStreamReader:
            return CursorReader(fetch, self.options["collections"].split(","), int(self.options.get("maxpages", 100)))

    return Cursors
