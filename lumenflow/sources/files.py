"""File sources and sinks: image folders, golden lists, gallery tables, paged APIs, result messages."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

IMAGE = r"(?i)\.(jpe?g|png|heic|webp|tiff?)$"


def image_files(spark: SparkSession, root: str, jpg_only: bool = False, content: bool = False) -> DataFrame:
    """(path, gallery, name[, content]) of images below a folder (no pattern); gallery: the first two folders."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    at = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    top = at.makeQualified(fs.getUri(), fs.getWorkingDirectory()).toUri().getPath().strip("/")  # relative roots too
    rel = F.regexp_replace("path", rf"^([A-Za-z][A-Za-z0-9+.-]*:)?(//[^/]*)?/*\Q{top}\E/+", "")
    parts = F.split(rel, "/")
    df = files.withColumns({"_rel": rel, "gallery": F.array_join(F.slice(parts, 1, F.least(F.lit(2), F.size(parts) - 1)), "/"), "name": F.element_at(parts, -1)})
    df = df.filter(F.col("path").rlike(r"(?i)\.jpe?g$" if jpg_only else IMAGE) & ~F.col("path").rlike(r"(?i)\.livephoto"))
    return df.select("path", "gallery", "name", *(["content"] if content else []))


def golden_list(spark: SparkSession, path: str) -> DataFrame:
    """(cut, file) of a JSON selection: a list, or an object with ``files``; items are names or {cut, file}.

    The cut is the first letter in upper case, A by default. A selection without any file fails.
    """
    raw = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("v"))
    items = F.coalesce(F.try_variant_get("v", "$.files", "array<variant>"), F.try_variant_get("v", "$", "array<variant>"))
    some = F.when(F.size(items) > 0, items).otherwise(F.raise_error(F.lit(f"no selection in {path}")))
    item = raw.select(F.posexplode(some).alias("pos", "i"))
    name = F.coalesce(F.try_variant_get("i", "$.file", "string"), F.try_variant_get("i", "$", "string"))
    return item.select("pos", F.substring(F.upper(F.coalesce(F.try_variant_get("i", "$.cut", "string"), F.lit("A"))), 1, 1).alias("cut"), name.alias("file"))


def golden_ids(photos: DataFrame, golden: DataFrame, name: str = "original_file_name") -> tuple[DataFrame, DataFrame]:
    """Photo ids of the listed names (of equal names the last photo), and the names that aren't there."""
    last = photos.groupBy(F.col(name).alias("file")).agg(F.max_by("photo_id", F.struct("display_order", "photo_id")).alias("photo_id"))
    wanted = golden.select("file").distinct()
    return wanted.join(last, "file"), wanted.join(last, "file", "left_anti")


def write_gallery(df: DataFrame, path: str) -> None:
    """A gallery table, one folder for each gallery."""
    df.write.mode("overwrite").partitionBy("gallery_id").parquet(path)


def read_gallery(spark: SparkSession, path: str, gallery_id=None) -> DataFrame:
    df = spark.read.parquet(path)
    return df if gallery_id is None else df.filter(F.col("gallery_id") == gallery_id)


def result_messages(results: DataFrame, size: int = 8) -> DataFrame:
    """(gallery_id, chunk, body): contract v1 messages of up to ``size`` results, as compact JSON."""
    from lumenflow.operators.windows import chunks

    photo = F.struct(F.col("photo_id").alias("photoId"), F.col("storage_key").alias("storageKey"), F.col("preview_key").alias("previewKey"), "vector")
    g = results.withColumn("chunk", chunks(size)).groupBy("gallery_id", "chunk", "embedding_model").agg(F.array_sort(F.collect_list(photo)).alias("photos"))
    return g.select("gallery_id", "chunk", F.to_json(F.struct(F.lit(1).alias("v"), F.col("gallery_id").alias("galleryId"), F.col("embedding_model").alias("embeddingModel"), "photos")).alias("body"))


class PageRange(InputPartition):
    def __init__(self, collection: str):
        super().__init__(collection)
        self.collection = collection


class PagedReader(DataSourceReader):
    """Follows cursors of each collection, which is one partition.

    ``pages`` is the caller's own limit; without one, more than ``max_pages``
    fail rather than return a part.
    """

    def __init__(self, fetch: Callable, collections: list[str], pages: int | None, max_pages: int):
        self.fetch, self.collections, self.pages, self.max_pages = fetch, collections, pages, max_pages

    def partitions(self) -> list[InputPartition]:
        return [PageRange(c) for c in self.collections]

    def read(self, partition: PageRange) -> Iterator[tuple]:
        cursor = None
        for _ in range(self.max_pages if self.pages is None else self.pages):
            rows, cursor = self.fetch(partition.collection, cursor)
            for pos, row in enumerate(rows):
                yield (partition.collection, pos, row)
            if cursor is None:
                return
        if self.pages is None:
            raise RuntimeError(f"{partition.collection} has more than {self.max_pages} pages")


def paged_source(name: str, fetch: Callable, max_pages: int = 1000) -> type[DataSource]:
    """A Spark data source of a cursor-paged API; ``fetch(collection, cursor) -> (JSON rows, next cursor or None)``.

    The option ``maxpages`` takes the first pages only.
    """

    class Paged(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return "collection string, pos int, body string"

        def reader(self, schema) -> DataSourceReader:
            return PagedReader(fetch, self.options["collections"].split(","), int(self.options["maxpages"]) if "maxpages" in self.options else None, max_pages)

    return Paged


def search(documents: DataFrame, text: str, query: str) -> DataFrame:
    return documents.filter(F.contains(F.lower(text), F.lit(query.lower())))


_OPS: dict[str, Callable[[Column, object], Column]] = {
    "equals": lambda c, v: c == F.lit(v),
    "does_not_equal": lambda c, v: ~c.eqNullSafe(F.lit(v)),
    "contains": lambda c, v: F.contains(c, F.lit(v)),
    "on_or_after": lambda c, v: c >= F.lit(v).cast("timestamp"),
    "on_or_before": lambda c, v: c <= F.lit(v).cast("timestamp"),
    "greater_than": lambda c, v: c > F.lit(v),
    "less_than": lambda c, v: c < F.lit(v),
    "is_empty": lambda c, v: c.isNull() if v else c.isNotNull(),
}


def predicate(spec: dict) -> Column:
    """A column from a nested filter: {and: […]}, {or: […]} or {property, <kind>: {op: value}}."""
    for key, start, join in (("and", F.lit(True), lambda a, b: a & b), ("or", F.lit(False), lambda a, b: a | b)):
        if key in spec:
            out = start
            for x in spec[key]:
                out = join(out, predicate(x))
            return out
    column = F.col(spec["property"])
    ops = [v for k, v in spec.items() if k != "property"][0]
    (op, value), *_ = ops.items()
    return _OPS[op](column, value)


def xlsx_golden(files: DataFrame, marked_only: bool = False) -> DataFrame:
    """(path, pos, cut, file) of selection sheets (path, content): rows with a cut (A컷 or B컷) and a picture's name.

    A bare letter counts too, but not with ``marked_only``.
    The first sheet of a file counts, of a few rows; a file without any such row fails.
    """
    mark = r"([ABab])컷" if marked_only else r"([ABab])\s*(?:컷|cut)?"

    def run(batches: Iterator) -> Iterator:
        import io
        import re
        import zipfile
        from xml.etree import ElementTree

        import pandas as pd

        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                book = zipfile.ZipFile(io.BytesIO(content))
                texts = lambda node: "".join(t.text or "" for t in node.iter() if t.tag.endswith("}t"))
                shared = [texts(s) for s in ElementTree.fromstring(book.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in book.namelist() else []
                rows = []
                for name in sorted(n for n in book.namelist() if n.startswith("xl/worksheets/sheet"))[:1]:
                    for row in (r for r in ElementTree.fromstring(book.read(name)).iter() if r.tag.endswith("}row")):
                        cells = []
                        for c in row:
                            value = next((v.text for v in c if v.tag.endswith("}v")), None)
                            cells.append(shared[int(value)] if c.get("t") == "s" and value else texts(c) or value or "")
                        cut = next((m[1].upper() for x in cells if (m := re.fullmatch(mark, x.strip()))), None)
                        file = next((x.strip() for x in cells if re.search(IMAGE, x.strip())), None)
                        if cut and file:
                            rows.append((path, len(rows), cut, file))
                if not rows:
                    raise ValueError(f"no selection in {path}")
                yield pd.DataFrame(rows, columns=["path", "pos", "cut", "file"])

    return files.select("path", "content").mapInPandas(run, "path string, pos long, cut string, file string")


def fetched(refs: DataFrame, key: str, make: Callable[[], Callable[[str], bytes | None]], retries: int = 3) -> DataFrame:
    """The refs with content and status (ok or missing) of an object store.

    ``make`` builds a getter once in each task; it returns None for an object
    that isn't there. Any other failure is tried again, then fails the task.
    """
    from pyspark.sql import types as T

    schema = T.StructType([*refs.schema.fields, *T.StructType.fromDDL("content binary, status string").fields])

    def run(batches: Iterator) -> Iterator:
        import time

        get = make()
        for pdf in batches:
            found = []
            for k in pdf[key]:
                for attempt in range(retries):
                    try:
                        found.append(get(k))
                        break
                    except Exception:
                        if attempt == retries - 1:
                            raise
                        time.sleep(0.5 * 2**attempt)
            yield pdf.assign(content=found, status=["missing" if c is None else "ok" for c in found])

    return refs.mapInPandas(run, schema)


def put(objects: DataFrame, make: Callable[[], Callable[[str, bytes], None]]) -> None:
    """Writes (key, content) rows; a task that runs again writes the same objects again."""

    def run(rows: Iterator) -> None:
        write = make()
        for r in rows:
            write(r.key, bytes(r.content))

    objects.select("key", "content").foreachPartition(run)


def inventory(objects: DataFrame) -> DataFrame:
    """(kind, id, title): databases, and pages that are no database's rows."""
    kind = F.when(F.col("object") == "database", "database").when((F.col("object") == "page") & ~F.col("parent_type").eqNullSafe("database_id"), "page")
    return objects.select(kind.alias("kind"), "id", "title").filter("kind is not null")
