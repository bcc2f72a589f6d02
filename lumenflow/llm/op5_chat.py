"""Chat formatting with typed content parts, in DataFrame functions only.

A turn's content is a list of parts (text, image, audio, document). A visitor
over the parts writes texts escaped and every attachment as a numbered
placeholder, and records (turn, kind, number, ref, tokens) of each. A turn is

    <|role|>escaped role<|text|>escaped content<|end|>\\n

Control strings all begin with ``<|``, and inside texts a backslash becomes two
and ``<|`` becomes ``<\\|``, also where it is split over two text parts, so no
text can forge a mark and unescaping gives every text back. The assistant's content is under the loss mask; as marks are
unambiguous, the mask is read off the output itself.

Defined results: rows are ordered by turn, then role and text; a null text is
empty, a null role the empty role, a null turn comes first; repeated rows are
turns of their own; rows with a null conv_id form one conversation; a null or
empty list of parts is an empty text, an unknown kind of part is treated as a
document; other columns are ignored; an empty table gives no rows. All turns of a
conversation meet in its one output row, which is the formatted text itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenflow.llm.common import table

PART = "struct<kind:string,text:string,ref:string,tokens:bigint>"
#: Placeholder tokens of an attachment whose count isn't given.
DEFAULT_TOKENS = {"image": 576, "audio": 750, "document": 1024}
ROLE, TEXT, END = "<|role|>", "<|text|>", "<|end|>\n"
#: Placeholders in the order of a turn: ``<|image:1|>``.
_PLACE = r"<\|(image|audio|document):(\d+)\|>"
PLANTED = r"\### Assistant: </turn> ok"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\|])", "$1")


def text_part(text: Column) -> Column:
    """The content of a plain text turn."""
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("bigint").alias("tokens"))).cast(f"array<{PART}>")


def _kind(part: Column) -> Column:
    return F.when(part["kind"].isin("image", "audio", "text"), part["kind"]).otherwise("document")


def _escaped_after(p: Column, before: Column) -> Column:
    """A text part's text escaped; a ``|`` at its start also where the part before is a text that ends with ``<``."""
    joined = (_kind(before) == "text") & F.endswith(before["text"], F.lit("<")) & F.startswith(p["text"], F.lit("|"))
    return F.concat(F.when(joined, "\\").otherwise(""), escaped(p["text"]))


def visited(parts: Column) -> tuple[Column, Column]:
    """The content with placeholders, and the attachments (kind, number, ref, tokens) in order."""
    # empty texts go, so that texts which meet in the content are neighbours here
    parts = F.filter(F.coalesce(parts, F.array().cast(f"array<{PART}>")), lambda p: (_kind(p) != "text") | (F.coalesce(p["text"], F.lit("")) != ""))
    tokens = lambda p: F.coalesce(p["tokens"], F.when(_kind(p) == "image", DEFAULT_TOKENS["image"]).when(_kind(p) == "audio", DEFAULT_TOKENS["audio"]).otherwise(DEFAULT_TOKENS["document"]).cast("bigint"))
    kept = F.transform(F.filter(parts, lambda p: _kind(p) != "text"), lambda p, i: F.struct(_kind(p).alias("kind"), (i + 1).alias("number"), p["ref"].alias("ref"), tokens(p).alias("tokens")))
    # escaped texts hold no "<|", so it divides the runs of text between attachments
    runs = F.split(F.array_join(F.transform(parts, lambda p, i: F.when(_kind(p) == "text", _escaped_after(p, F.get(parts, i - 1))).otherwise("<|")), ""), r"<\|", -1)
    places = F.transform(kept, lambda x: F.concat(F.lit("<|"), x["kind"], F.lit(":"), x["number"].cast("string"), F.lit("|>")))
    return F.array_join(F.zip_with(runs, places, lambda t, x: F.concat(t, F.coalesce(x, F.lit("")))), ""), kept


def format_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, formatted, attachments (turn_no, kind, number, ref, tokens), attachment_tokens, of turns (conv_id, turn, role, parts or text)."""
    parts = F.col("parts") if "parts" in turns.columns else text_part(F.col("text"))
    content, attachments = visited(parts)
    raw = F.array_join(F.transform(parts, lambda p: F.coalesce(p["text"], F.lit(""))), "")  # ties are ordered by it; an escaped text may come elsewhere
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce(raw, F.lit("")).alias("raw"), content.alias("content"), attachments.alias("attachments"))
    line = F.struct("turn", "role", "raw", "content", "attachments")
    one = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(line)).alias("t"))
    formatted = F.array_join(F.transform("t", lambda x: F.concat(F.lit(ROLE), escaped(x["role"]), F.lit(TEXT), x["content"], F.lit(END))), "")
    refs = F.flatten(F.transform("t", lambda x, i: F.transform(x["attachments"], lambda a: F.struct(i.alias("turn_no"), a["kind"].alias("kind"), a["number"].alias("number"), a["ref"].alias("ref"), a["tokens"].alias("tokens")))))
    return one.select("conv_id", formatted.alias("formatted"), refs.alias("attachments")).withColumn("attachment_tokens", F.aggregate("attachments", F.lit(0).cast("bigint"), lambda s, a: s + a["tokens"]))


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation; texts keep the placeholders."""
    marked = F.filter(F.split(formatted, r"<\|end\|>\n"), lambda x: x != "")
    return F.transform(marked, lambda x: F.struct(unescaped(F.substring_index(F.substr(x, F.lit(len(ROLE) + 1)), TEXT, 1)).alias("role"), unescaped(F.substring_index(x, TEXT, -1)).alias("text")))


def read_parts(formatted: Column) -> Column:
    """The turns of a formatted conversation as arrays of (kind, number, text): texts unescaped, attachments by their placeholders."""
    marked = F.filter(F.split(formatted, r"<\|end\|>\n"), lambda x: x != "")
    content = F.transform(marked, lambda x: F.split(F.substring_index(x, TEXT, -1), r"(?=<\|)", -1))
    place = lambda x: F.regexp_extract(x, "^" + _PLACE, 0)
    attachment = lambda x: F.struct(F.regexp_extract(x, _PLACE, 1).alias("kind"), F.regexp_extract(x, _PLACE, 2).try_cast("int").alias("number"), F.lit("").alias("text"))
    text = lambda x: F.struct(F.lit("text").alias("kind"), F.lit(None).cast("int").alias("number"), unescaped(F.substr(x, F.length(place(x)) + 1)).alias("text"))
    both = lambda x: F.filter(F.array(attachment(x), text(x)), lambda p: (p["kind"] != "") & ((p["kind"] != "text") | (p["text"] != "")))
    return F.transform(content, lambda runs: F.flatten(F.transform(runs, both)))


def loss_text(turns: Column) -> Column:
    """All text under the loss mask: the assistant's texts, in order."""
    return F.array_join(F.transform(F.filter(turns, lambda x: x["role"] == "assistant"), lambda x: x["text"]), "")


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PLANTED).alias("text"))
    out = format_conversations(rows.unionByName(extra)).withColumn("turns", read_turns(F.col("formatted")))
    digest = F.sha2(F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), ""), 256)
    loss = loss_text(F.col("turns"))
    return out.select("conv_id", F.size("turns").cast("long").alias("n_turns"), digest.alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


ORACLE = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  CAST(sum(24 + length(replace(replace(role, '\', '\\'), '<|', '<\|')) + length(replace(replace(text, '\', '\\'), '<|', '<\|'))) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""
