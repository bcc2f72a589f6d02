"""Fingerprints, likenesses and edits against a plain version, row by row."""

import hashlib
import re
from zlib import crc32

import pytest

xxhash = pytest.importorskip("xxhash")
pytest.importorskip("public_tokenizers")
from lumenflow.llm import op6_fingerprint as op6  # noqa: E402

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_fingerprint(text: str) -> str:
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text.translate(FOLD)) if w]
    if not words:
        return "00" * 128
    codes = [xxhash.xxh64_intdigest(w.encode(), seed=42).to_bytes(8, "little") for w in words]
    least: dict[int, int] = {}
    for k in range(max(1, len(codes) - 4)):
        h = 42
        for code in codes[k : k + 5]:
            h = xxhash.xxh64_intdigest(code, seed=h)
        h &= (1 << 55) - 1
        least[h >> 48] = min(h, least.get(h >> 48, h))
    out = []
    for b in range(128):
        asked = [b, *sorted(range(128), key=lambda j, b=b: crc32(f"29:{b}:{j}".encode()))]
        out.append(least[next(j for j in asked if j in least)] & 255)
    return bytes(out).hex()


def plain_likeness(a: str, b: str) -> float:
    same = sum(x == y for x, y in zip(bytes.fromhex(a), bytes.fromhex(b), strict=True)) / 128
    return max(0.0, (same - 1 / 256) / (1 - 1 / 256))


def plain_rows(rows: list) -> list:
    texts = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()), reverse=True)
    out = []
    for k, (i, t) in enumerate(texts):
        following = texts[(k + 1) % len(texts)][1]
        third = len(t) // 3
        edited = t[: len(t) - third] + following[:third]
        a, b, c = map(plain_fingerprint, (t, edited, following))
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), a, b, round(plain_likeness(a, b), 12), round(plain_likeness(a, c), 12)))
    return sorted(out, key=str)


def rows_of(spark, rows: list, ranges: int) -> list:
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted([(*r[:5], round(r[5], 12), round(r[6], 12)) for r in op6.fingerprint_edits(df, ranges).collect()], key=str)


@pytest.fixture(scope="module")
def odd_rows() -> list:
    long = " ".join(f"w{k * k % 977}" for k in range(4000))
    some = [(i, " ".join(f"t{(i // 3) * 31 + k * (i % 3 + 1) % 57}" for k in range(i % 41))) for i in range(120)]
    return [*some, (500, long), (501, long + " end"), (502, "x" * 100_000), (503, None), (504, ""), (505, " \t\n"), (506, "É é ß \U0001f600 two"), (7, "other text of doc seven"), (8, some[8][1]), (8, some[8][1]), (None, "no id here"), (None, None), (-4, "ONE two Three four FIVE six")]


@pytest.mark.parametrize("ranges", [1, 3, 64])
def test_rows_by_brute_force(spark, odd_rows, ranges):
    assert rows_of(spark, odd_rows, ranges) == plain_rows(odd_rows)


def test_few_rows_by_brute_force(spark):
    for rows in ([], [(1, "a b c")], [(1, None)], [(2, "a b c d e f"), (2, "a b c d e f")], [(None, "x y")]):
        assert rows_of(spark, rows, 4) == plain_rows(rows)
