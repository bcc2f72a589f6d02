"""Secret scans with multipart credential linking.

One pass over the texts finds, per document, the base matches (assign, access,
hex) and weak parts: short assigned values and 40-sign keys (secret), short
access identifiers and named users (id), addresses and hosts (endpoint). Runs of
signs are found with numpy, and the expressions only run over texts that hold
one of their fixed words.

Then the parts are joined as intervals, within a document and ``SCOPE`` code
points: a part covers buckets of that width, each bucket keeps the least start
and greatest end of a role, and a part meets the buckets it can reach, so rows
grow with the parts, never with pairs of them. A weak secret is reported if an id
or an endpoint lies within the scope, a weak id if a secret does, an endpoint if
both do. Base matches are always reported and count as parts.

Defined results: a null text counts as empty; rows that repeat are scanned each;
a null doc_id is scanned as any other; other columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenflow.llm.common import map_batches, stored, table
from lumenflow.llm.textops import blocks

SCOPE = 200
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
USER = re.compile(r"""(?:user(?:name)?|login|client_id|account)["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]{3,})""", re.IGNORECASE | re.ASCII)
URL = re.compile(r"[a-z][a-z0-9+.-]{1,20}://[A-Za-z0-9.:@_-]+")
ADDRESS = re.compile(r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?::[0-9]+)?(?![0-9.])")
HOST = ".amazonaws.com"
_HOST_RUN = re.compile(r"[A-Za-z0-9.-]+")
#: Base kinds as listed, then the weak ones.
KINDS = ["assign", "access", "hex", "secret", "id", "endpoint"]
_ROLE = {"assign": "secret", "hex": "secret", "access": "id", "secret": "secret", "id": "id", "endpoint": "endpoint"}
_WORDS = [b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key"]
_NAMES = [b"user", b"login", b"client_id", b"account"]
_HEX = np.zeros(256, dtype=bool)
_HEX[[*range(48, 58), *range(97, 103)]] = True
_KEY = np.zeros(256, dtype=bool)
_KEY[[*range(48, 58), *range(65, 91), *range(97, 123), 43, 47]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base string, parts array<struct<kind:string,start:long,end:long>>"
_PART = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])


def runs(inside: np.ndarray, offsets: np.ndarray, least: int, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the longest runs of such bytes within each row."""
    padded = np.zeros(len(inside) + 2, dtype=bool)
    padded[1:-1] = inside
    cut = np.zeros(len(inside) + 1, dtype=bool)
    cut[offsets] = True
    starts = np.flatnonzero(padded[1:] & (~padded[:-1] | cut))
    ends = np.flatnonzero(padded[:-1] & (~padded[1:] | cut))
    size = ends - starts
    keep = (size >= least) & (size <= most if most else True)
    return starts[keep], ends[keep]


def holding(low: bytes, words: list[bytes], offsets: np.ndarray) -> set[int]:
    """Rows that hold one of the words; a word never spans rows by more than a needless look."""
    found = set()
    for w in words:
        at = low.find(w)
        while at >= 0:
            row = int(np.searchsorted(offsets, at, side="right")) - 1
            found.add(row)
            at = low.find(w, max(at + 1, int(offsets[row + 1]) - len(w) + 1))
    return found


def endpoints(text: str) -> list[tuple[int, int]]:
    """URLs, addresses and hosts that don't overlap; each run of signs is looked at once, so time grows with the text."""
    found = [m.span() for m in URL.finditer(text)] if "://" in text else []
    more = [m.span() for m in ADDRESS.finditer(text)]
    if HOST in text:
        for m in _HOST_RUN.finditer(text):
            at = text.rfind(HOST, m.start() + 1, m.end())
            if at > 0:
                more.append((m.start(), at + len(HOST)))
    out, end = [], 0
    for a, b, _ in sorted([(a, b, 0) for a, b in found] + [(a, b, 1) for a, b in more], key=lambda s: (s[0], s[2])):
        if a >= end:
            out.append((a, b))
            end = b
    return out


def scan(text: str, hexes: list[tuple[int, int]], keys: list[tuple[int, int]], assigned: bool, access: bool, named: bool) -> tuple[list[tuple], list[tuple]]:
    """Base spans and weak ones, (start, end, kind)."""
    base = [(a, b, "hex") for a, b in hexes]
    weak = []
    if assigned:
        for m in ASSIGN.finditer(text):
            if len(m[2]) >= 12:
                base.append((m.start(), m.end(), "assign"))
            elif len(m[2]) >= 4:
                weak.append((m.start(), m.end(), "secret"))
    if access:
        for m in ACCESS.finditer(text):
            (base if m.end() - m.start() >= 18 else weak).append((m.start(), m.end(), "access" if m.end() - m.start() >= 18 else "id"))
    if named:
        weak += [(m.start(), m.end(), "id") for m in USER.finditer(text)]
    taken = {(a, b) for a, b, _ in base}
    weak += [(a, b, "secret") for a, b in keys if (a, b) not in taken]
    if any(_ROLE[k] == "secret" for *_, k in base + weak):
        weak += [(a, b, "endpoint") for a, b in endpoints(text)]
    return base, weak


def _joined(spans: list[tuple]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1])))


def base_matches(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, base (kind:start:end, comma-joined), parts (all base and weak spans)."""

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for first, last, data, offsets in blocks(batch.column(1)):
            raw = data.tobytes()
            low = _LOWER[data].tobytes()
            hexes = runs(_HEX[data], offsets, 16)
            keys = runs(_KEY[data], offsets, 40, 40)
            sets = [holding(low, _WORDS, offsets), holding(raw, [b"AKIA"], offsets), holding(low, _NAMES, offsets)]
            of = [np.searchsorted(offsets, s, side="right") - 1 for s in (hexes[0], keys[0])]
            out = [(0, 0, 0, "", [])] * (last - first)
            for row in sorted(set(of[0].tolist()) | set(of[1].tolist()) | sets[0] | sets[1] | sets[2]):
                piece = data[offsets[row] : offsets[row + 1]]
                text = piece.tobytes().decode("utf-8", "replace")
                before = np.zeros(len(piece) + 1, dtype=np.int64)
                np.cumsum((piece & 0xC0) != 0x80, out=before[1:])
                spans = []
                for (starts, ends), own in zip((hexes, keys), of, strict=True):
                    a, b = np.searchsorted(own, [row, row + 1])
                    spans.append(list(zip(before[starts[a:b] - offsets[row]].tolist(), before[ends[a:b] - offsets[row]].tolist(), strict=True)))
                base, weak = scan(text, *spans, row in sets[0], row in sets[1], row in sets[2])
                if base or weak:
                    n = [sum(k == kind for *_, k in base) for kind in KINDS[:3]]
                    out[row] = (*n, _joined(base), [{"kind": k, "start": a, "end": b} for a, b, k in base + weak])
            columns = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), *[pa.array(c, type=pa.int64()) for c in columns[:3]], pa.array(columns[3], type=pa.string()), pa.array(columns[4], type=pa.list_(_PART))], names=["doc_id", "n_assign", "n_access", "n_hex", "base", "parts"])

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), work, _SCHEMA)


def linked_parts(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Of the weak parts (uid, kind, start, end) those with complementary parts within the scope."""
    role = F.create_map(*[F.lit(x) for kv in _ROLE.items() for x in kv])[F.col("kind")]
    parts = parts.select("uid", "kind", "start", "end", role.alias("role")).distinct()
    width = F.lit(scope)
    cell = lambda c: F.floor(c / width)
    reach = parts.select("uid", "role", "start", "end", F.explode(F.sequence(cell(F.col("start")), cell(F.col("end")))).alias("cell"))
    cells = reach.groupBy("uid", "cell", "role").agg(F.min("start").alias("least"), F.max("end").alias("most")).withColumnRenamed("role", "other")
    weak = parts.filter(F.col("kind").isin("secret", "id", "endpoint")).select("*", F.explode(F.sequence(cell(F.col("start") - width), cell(F.col("end") + width))).alias("cell"))
    met = weak.join(cells, ["uid", "cell"]).filter((F.col("other") != F.col("role")) & (F.greatest(F.col("least") - F.col("end"), F.col("start") - F.col("most")) <= width))
    flags = met.groupBy("uid", "kind", "start", "end").agg(*[F.max(F.col("other") == r).alias(r) for r in ("secret", "id", "endpoint")])
    ok = F.when(F.col("kind") == "secret", F.col("id") | F.col("endpoint")).when(F.col("kind") == "id", F.col("secret")).otherwise(F.col("secret") & F.col("id"))
    return flags.filter(ok).select("uid", "kind", "start", "end")


def find_secrets(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base and spans (arrays of start, rank of kind, end, kind) of every document."""
    found = stored(base_matches(docs).withColumn("uid", F.monotonically_increasing_id()), "op9-found")
    parts = found.filter(F.size("parts") > 0).select("uid", F.explode("parts").alias("p")).select("uid", "p.*")
    linked = linked_parts(parts, scope)
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    every = parts.filter(F.col("kind").isin(*KINDS[:3])).unionByName(linked)
    spans = every.distinct().groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("start", rank.alias("rank"), "end", "kind"))).alias("spans"))
    return found.join(spans, "uid", "left").select("doc_id", "n_assign", "n_access", "n_hex", "base", "spans")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return find_secrets(table(spark, sf_dir, "documents")).select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), F.coalesce(spans, F.lit("")).alias("spans"))
