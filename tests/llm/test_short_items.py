"""Test items of one or two words are found as whole word sequences."""

import re

from lumenflow.llm.op10_decontamination import contaminated

WORD = re.compile(r"[0-9A-Za-z\x80-\U0010ffff]+")


def test_short_items_by_brute_force(spark):
    items = [(1, "Quizzical zebra"), (2, "ok"), (3, "!?"), (4, None), (5, "a a"), (6, "Größe"), (7, "ok"), (None, "ok"), (2, "ok"), (8, "one two three four five six")]
    docs = [(10, "a quizzical, ZEBRA ran"), (11, "zebra quizzical"), (12, "ok"), (13, "okay quizzical"), (14, "a a a b OK ok"), (15, None), (16, ""), (17, "die größe, die Größe"), (18, "quizzical"), (18, "zebra"), (None, "ok"), (19, "x " * 9000 + "ok " + "x " * 9000), (20, "one two three four five six ok")]
    got = contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), short=True).collect()
    words = lambda t: [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(t or "")]
    want = set()
    for d, text in docs:
        for i, item in items:
            w, q = words(text), words(item)
            ends = [k + len(q) - 1 for k in range(len(w) - len(q) + 1) if w[k : k + len(q)] == q] if 0 < len(q) < 3 else []
            if ends and d is not None and i is not None:
                want.add((d, i, 1.0, len(q), max(ends)))
    want.add((20, 8, 1.0, 6, 5))
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_no_documents_and_short_items(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert contaminated(none, spark.createDataFrame([(1, "ok")], "item_id long, text string"), short=True).count() == 0
