"""Block trees, properties, events and answers of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KST = "Asia/Seoul"
#: Signs of a document's markdown.
WEEKDAYS = "월화수목금토일"
TOGGLE, CALLOUT, PAGE, DATABASE = "▸ ", "> 💡 ", "📄 하위 페이지: ", "🗃 하위 데이터베이스: "
UNTITLED, ALL_DAY, ONGOING, TODAY, TOMORROW, AFTER, DAYS = "(제목 없음)", " 종일", "진행 중", "오늘", "내일", "모레", "일 후"
DEPTH_NOTE = ('… (깊이 제한 — list_children("', '")로 확장 가능)')
LINKED = "건 연결"
MEDIA = ["image", "video", "file", "pdf", "embed", "bookmark"]


def rich_text(items) -> Column:
    """Pieces (plain_text, href) as one text, links as [text](href)."""
    piece = lambda x: F.when(x["href"].isNotNull() & (x["href"] != ""), F.concat(F.lit("["), F.coalesce(x["plain_text"], F.lit("")), F.lit("]("), x["href"], F.lit(")"))).otherwise(F.coalesce(x["plain_text"], F.lit("")))
    return F.coalesce(F.array_join(F.transform(items, piece), ""), F.lit(""))


def numbered(blocks: DataFrame) -> DataFrame:
    """number of numbered list items: it begins anew when the sibling before is of another type."""
    w = Window.partitionBy("doc_id", "parent_id").orderBy("pos")
    run = F.sum((F.col("type") != "numbered_list_item").cast("int")).over(w)
    b = blocks.withColumn("_run", run)
    n = F.sum((F.col("type") == "numbered_list_item").cast("int")).over(Window.partitionBy("doc_id", "parent_id", "_run").orderBy("pos"))
    return b.withColumn("number", F.when(F.col("type") == "numbered_list_item", n)).drop("_run")


def block_line(depth) -> Column:
    """A block's own markdown, indented by its depth; empty where it has none."""
    indent = F.repeat(F.lit("  "), depth)
    t, text = F.col("type"), F.col("text")
    mark = (
        F.when(t == "paragraph", text)
        .when(t.isin("heading_1", "heading_2", "heading_3"), F.concat(F.repeat(F.lit("#"), F.right(t, F.lit(1)).try_cast("int")), F.lit(" "), text))
        .when(t == "bulleted_list_item", F.concat(F.lit("- "), text))
        .when(t == "numbered_list_item", F.concat(F.col("number").cast("string"), F.lit(". "), text))
        .when(t == "to_do", F.concat(F.when(F.col("checked"), "- [x] ").otherwise("- [ ] "), text))
        .when(t == "toggle", F.concat(F.lit(TOGGLE), text))
        .when(t == "code", F.concat(F.lit("```"), F.coalesce("language", F.lit("")), F.lit("\n"), text, F.lit("\n"), indent, F.lit("```")))
        .when(t == "quote", F.concat(F.lit("> "), text))
        .when(t == "callout", F.concat(F.lit(CALLOUT), text))
        .when(t == "divider", F.lit("---"))
        .when(t == "child_page", F.concat(F.lit(PAGE), F.coalesce("title", F.lit("")), F.lit(" (id: "), "block_id", F.lit(")")))
        .when(t == "child_database", F.concat(F.lit(DATABASE), F.coalesce("title", F.lit("")), F.lit(" (id: "), "block_id", F.lit(")")))
        .when(t.isin(*MEDIA), F.rtrim(F.concat(F.lit("["), t, F.lit("] "), F.coalesce("url", F.lit("")))))
        .otherwise(text)
    )
    return F.when(mark != "", F.concat(indent, mark)).otherwise(F.when(t == "paragraph", F.when(indent != "", indent)))


def markdown(blocks: DataFrame, max_depth: int = 3) -> DataFrame:
    """(doc_id, markdown) of block rows (doc_id, block_id, parent_id, pos, type, text, cells, …).

    One join for each level of the tree; blocks deeper than ``max_depth`` are
    named in a note. A table's rows are its lines. A document's lines meet in its
    one output row.
    """
    b = numbered(blocks).withColumn("_key", F.format_string("%08d", "pos"))
    parents = blocks.select("doc_id", F.col("parent_id").alias("block_id")).filter("block_id is not null").distinct().withColumn("_has", F.lit(True))
    b = b.join(parents, ["doc_id", "block_id"], "left")
    level = b.filter("parent_id is null").withColumns({"path": F.col("_key"), "depth": F.lit(0), "in_table": F.lit(False)})
    levels = []
    for depth in range(max_depth + 1):
        closed = F.col("type").isin("child_page", "child_database", "table")
        row = F.concat(F.repeat(F.lit("  "), F.col("depth") - 1), F.lit("| "), F.array_join("cells", " | "), F.lit(" |"))
        rule = F.when(F.col("pos") == 0, F.concat(F.lit("\n"), F.repeat(F.lit("  "), F.col("depth") - 1), F.lit("|"), F.repeat(F.lit("---|"), F.size("cells")))).otherwise("")
        line = F.when(F.col("in_table"), F.concat(row, rule)).when(F.col("type") == "table", None).otherwise(block_line(F.col("depth")))
        level = level.withColumn("line", line)
        levels.append(level.select("doc_id", "path", "line"))
        if depth == max_depth:
            note = F.concat(F.repeat(F.lit("  "), F.col("depth")), F.lit("  " + DEPTH_NOTE[0]), "block_id", F.lit(DEPTH_NOTE[1]))
            levels.append(level.filter(F.col("_has") & ~closed & ~F.col("in_table")).select("doc_id", F.concat("path", F.lit("~")).alias("path"), note.alias("line")))
            break
        up = level.filter(~F.col("type").isin("child_page", "child_database") & ~F.col("in_table")).select("doc_id", F.col("block_id").alias("parent_id"), F.col("path").alias("_up"), (F.col("type") == "table").alias("in_table"))
        level = b.join(up, ["doc_id", "parent_id"]).withColumns({"path": F.concat_ws("/", "_up", "_key"), "depth": F.lit(depth + 1)}).drop("_up")
    lines = levels[0]
    for x in levels[1:]:
        lines = lines.unionByName(x)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "line"))), lambda s: s["line"]), "\n")
    return lines.filter("line is not null").groupBy("doc_id").agg(joined.alias("markdown"))


def property_text(p) -> Column:
    """The value of a property struct by its type; empty where there is none."""
    t = p["type"]
    names = F.array_join(p["names"], ", ")
    return F.coalesce(
        F.when(t.isin("title", "rich_text"), rich_text(p["rich_text"]))
        .when(t.isin("select", "status"), F.get(p["names"], F.lit(0)))
        .when(t.isin("multi_select", "people"), names)
        .when(t == "date", F.concat(p["start"], F.when(p["end"].isNotNull(), F.concat(F.lit("~"), p["end"])).otherwise("")))
        .when(t == "checkbox", F.initcap(p["value"]))
        .when(t.isin("number", "url", "email", "phone_number"), p["value"])
        .when(t == "relation", F.concat(F.size(p["names"]).cast("string"), F.lit(LINKED))),
        F.lit(""),
    )


def properties_text(properties) -> Column:
    """"name: value" of properties in their order, joined by " / "."""
    return F.array_join(F.filter(F.transform(properties, lambda p: F.when(property_text(p) != "", F.concat(p["name"], F.lit(": "), property_text(p)))), lambda x: x.isNotNull()), " / ")


def parsed_bound(value) -> Column:
    """struct<timed, ts, d> of a date or a date-time text; without an offset it is Korean time."""
    v = F.col(value) if isinstance(value, str) else value
    v = F.regexp_replace(v, r"T(\d{2}:\d{2})($|[Z+-])", "T$1:00$2")
    timed = F.contains(v, F.lit("T"))
    offset = v.rlike(r"(Z|[+-]\d{2}:?\d{2})$")
    ts = F.when(offset, F.try_to_timestamp(v)).otherwise(F.try_to_timestamp(F.concat(v, F.lit("+09:00"))))
    ts = F.when(timed, ts)
    local = F.from_utc_timestamp(ts, KST)  # with a UTC session
    return F.when(v.isNotNull() & (v != ""), F.struct(timed.alias("timed"), ts.alias("ts"), F.when(timed, F.to_date(local)).otherwise(v.try_cast("date")).alias("d"), local.alias("local")))


def weekday_label(d) -> Column:
    return F.concat(F.date_format(d, "yyyy-MM-dd"), F.lit("("), F.substring(F.lit(WEEKDAYS), F.weekday(d) + 1, F.lit(1)), F.lit(")"))


def _utc(text: str | Column) -> Column:
    """A moment written in UTC, whatever the session's time zone."""
    return F.to_utc_timestamp((F.lit(text) if isinstance(text, str) else text).cast("timestamp_ntz").cast("timestamp"), F.current_timezone())


def upcoming(events: DataFrame, now: str, keyword: str | None = None, limit: int = 30, grace_hours: int = 1) -> DataFrame:
    """Events (title, start, end, detail, url) not over at ``now`` (UTC text), with when, relative and their place.

    Open-ended timed events last ``grace_hours``, all-day ones through their day;
    an all-day event counts from midnight.
    """
    t = _utc(now)
    today = F.to_date(F.from_utc_timestamp(t, KST))
    e = events.withColumns({"s": parsed_bound("start"), "e": parsed_bound("end")}).filter("s is not null and s.d is not null")
    last = F.coalesce("e", "s")
    keep = F.when(last["timed"], F.when(F.col("e").isNull(), F.col("s.ts") + F.make_dt_interval(hours=F.lit(grace_hours)) >= t).otherwise(F.col("e.ts") >= t)).otherwise(last["d"] >= today)
    started = F.when(F.col("s.timed"), F.col("s.ts") < t).otherwise(F.col("s.d") < today)
    started = F.when(F.col("e").isNull() & ~F.col("s.timed"), F.col("s.d") < today).otherwise(started)
    e = e.filter(keep).withColumn("ongoing", started)
    if keyword and keyword.strip():
        k = keyword.strip().lower()
        e = e.filter(F.contains(F.lower("title"), F.lit(k)) | F.contains(F.lower("detail"), F.lit(k)))
    one = lambda b: F.when(b["timed"], F.concat(weekday_label(b["d"]), F.lit(" "), F.date_format(b["local"], "HH:mm"))).otherwise(F.concat(weekday_label(b["d"]), F.lit(ALL_DAY)))
    when = F.concat(one(F.col("s")), F.when(F.col("e").isNull(), "").when((F.col("e.d") == F.col("s.d")) & F.col("e.timed"), F.concat(F.lit("~"), F.date_format("e.local", "HH:mm"))).otherwise(F.concat(F.lit(" ~ "), one(F.col("e")))))
    days = F.datediff("s.d", today)
    relative = F.when(F.col("ongoing"), ONGOING).when(days == 0, TODAY).when(days == 1, TOMORROW).when(days == 2, AFTER).otherwise(F.concat(days.cast("string"), F.lit(DAYS)))
    at = F.coalesce("s.ts", F.to_utc_timestamp(F.col("s.d").cast("timestamp"), KST))
    e = e.withColumns({"at": at, "when_text": when, "relative": relative, "day": F.col("s.d")})
    return e.drop("s", "e").orderBy("at", "title").limit(max(1, min(limit, 30)))


def week_bounds(now: str | Column) -> tuple[Column, Column, Column]:
    """Monday, Saturday and Sunday of the week (Monday first) of a UTC time, in Korea."""
    today = F.to_date(F.from_utc_timestamp(_utc(now), KST))
    monday = F.date_sub(today, F.weekday(today))
    return monday, F.date_add(monday, 5), F.date_add(monday, 6)


def page_url(page_id, base: str) -> Column:
    return F.concat(F.lit(base), F.replace(page_id, F.lit("-"), F.lit("")))


def without_comments(text) -> Column:
    return F.regexp_replace(text, r"(?s)<!--.*?-->", "")


def date_stamp(text) -> Column:
    """The time of "YYYY-MM-DD(요일) HH:MM" in a text, in Korean time."""
    found = F.regexp_extract(text, r"(\d{4}-\d{2}-\d{2})\([월화수목금토일]\) (\d{2}:\d{2})", 0)
    plain = F.concat_ws(" ", F.substring(found, 1, 10), F.regexp_extract(found, r"(\d{2}:\d{2})$", 1))
    return F.when(found != "", F.to_timestamp_ntz(plain, F.lit("yyyy-MM-dd HH:mm")))


def judged(df: DataFrame) -> DataFrame:
    """failures of answers (answer, tools) against expect_any, expect_none, tool, not_tool (expressions, null: none)."""
    hit = lambda patterns: F.exists(patterns, lambda p: F.regexp_like("answer", p))
    used = lambda tool: F.array_contains("tools", tool)
    found = F.array(
        F.when(F.col("expect_any").isNotNull() & (F.size("expect_any") > 0) & ~hit("expect_any"), "missing"),
        F.when(F.col("expect_none").isNotNull() & hit("expect_none"), "forbidden"),
        F.when(F.col("tool").isNotNull() & ~used(F.col("tool")), "tool not used"),
        F.when(F.col("not_tool").isNotNull() & used(F.col("not_tool")), "tool forbidden"),
    )
    return df.withColumn("failures", F.filter(found, lambda x: x.isNotNull()))
