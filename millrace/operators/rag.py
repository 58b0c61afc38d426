"""Conversation tables around answer generation: history, context, citations, exchanges, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HISTORY, HISTORY_CHARS, TITLE = 4, 1200, 80
#: What an answer may say instead of citing, after trimming.
REFUSAL = "not enough information in the sources"
MARKER = r"\[([0-9]+)\]"


def history(messages: DataFrame) -> DataFrame:
    """conv_id, seq, role, content: of the last messages those of user and assistant, cut short."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("seq"))
    last = messages.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= HISTORY)
    return last.where(F.col("role").isin("user", "assistant")).select("conv_id", "seq", "role", F.substring("content", 1, HISTORY_CHARS).alias("content"))


def joined(rows: DataFrame, keys: list[str], order: str, block: Column, out: str, separator: str = "\n\n") -> DataFrame:
    """Blocks of each group in order as one text."""
    return rows.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), block.alias("b")))), lambda x: x["b"]), separator).alias(out))


def context(results: DataFrame) -> DataFrame:
    """query_id, context: numbered source blocks from (query_id, rank, title, page, text)."""
    label = F.when(F.col("page").isNotNull(), F.concat(F.col("title"), F.lit(" · page "), F.col("page").cast("string"))).otherwise(F.col("title"))
    block = F.concat(F.lit('<source index="'), F.col("rank").cast("string"), F.lit('">\n'), label, F.lit("\noriginal text\n"), F.col("text"), F.lit("\n</source>"))
    return joined(results, ["query_id"], "rank", block, "context")


def markers(content: Column) -> Column:
    return F.regexp_extract_all(content, F.lit(MARKER), 1)


def citations(answers: DataFrame) -> DataFrame:
    """conv_id, seq, position, marker: every [n] of an answer in order."""
    return answers.select("conv_id", "seq", F.posexplode(markers(F.col("content"))).alias("position", "marker"))


def citations_ok(content: Column, n_sources: Column) -> Column:
    """An answer cites, each time a source that there is, in plain digits; or it is the refusal."""
    found = markers(content)
    refusal = F.lower(F.regexp_replace(content, r"^[\s\p{P}]+|[\s\p{P}]+$", "")) == REFUSAL
    fine = F.forall(found, lambda m: m.rlike("^[1-9][0-9]*$") & F.coalesce(F.try_to_number(m, F.lit("9999999999")) <= n_sources, F.lit(False)))
    return ((F.size(found) > 0) | refusal) & fine


def exchanges(messages: DataFrame) -> DataFrame:
    """conv_id, seq, complete: each user message, and whether an assistant message follows it."""
    w = Window.partitionBy("conv_id").orderBy("seq")
    return messages.withColumn("next_role", F.lead("role").over(w)).where("role = 'user'").select("conv_id", "seq", F.coalesce(F.col("next_role") == "assistant", F.lit(False)).alias("complete"))


def conversation_title(question: Column) -> Column:
    return F.trim(F.substring(F.trim(question), 1, TITLE))


def conversation_markdown(messages: DataFrame, titles: DataFrame, sources: DataFrame, label: Column) -> DataFrame:
    """conv_id, markdown: title, the name of the knowledge base (``kb_name`` of the titles, where there is one), then each message under its role with numbered,
    quoted sources under their ``label``."""
    quoted = F.concat(F.lit("["), (F.col("position") + 1).cast("string"), F.lit("] "), label, F.lit("\n\n> "), F.regexp_replace("text", "\n", "\n> "))
    s = joined(sources, ["conv_id", "seq"], "position", quoted, "cited")
    m = messages.join(s, ["conv_id", "seq"], "left")
    block = F.concat(F.lit("## "), F.col("role"), F.lit("\n\n"), F.col("content"), F.coalesce(F.concat(F.lit("\n\n### Sources\n\n"), F.col("cited")), F.lit("")))
    body = joined(m, ["conv_id"], "seq", block, "body")
    base = F.coalesce(F.concat(F.lit("Knowledge base: "), F.col("kb_name"), F.lit("\n\n")), F.lit("")) if "kb_name" in titles.columns else F.lit("")
    return titles.join(body, "conv_id").select("conv_id", F.concat(F.lit("# "), F.col("title"), F.lit("\n\n"), base, F.col("body"), F.lit("\n")).alias("markdown"))


def safe_file_name(name: Column) -> Column:
    return F.concat(F.substring(F.regexp_replace(name, "[/\\\\:\n\r]", "-"), 1, 80), F.lit(".md"))


def note_markdown(title: Column, body: Column, default: str = "Untitled note") -> Column:
    return F.concat(F.lit("# "), F.coalesce(F.nullif(F.trim(title), F.lit("")), F.lit(default)), F.lit("\n\n"), body, F.lit("\n"))
