"""Chat formatting by event sourcing: fold each conversation's log, then render, then read back.

A log row is (conv_id, seq, turn, kind, role, text); ``kind`` is ``message`` (whole text), ``delta``
(appended), ``edit`` (replaces the turn's text), ``regenerate`` (drops the turn's text; deltas
follow) or ``delete`` (the turn goes). The log is partitioned by conversation and turn, sorted by
sequence, and folded: what counts is the last event that resets the turn and all deltas after it.
DataFrame functions only; two groupings, the first of which leaves one row a turn.

Template: ``<s>[NAME]`` text ``[/NAME]</s>``, where NAME is INST for role user and ``R:`` with the
escaped role otherwise. In texts and roles ``~``, ``<``, ``[`` and ``]`` become ``~0``, ``~1``,
``~2``, ``~3``, so no control string can occur inside one, and unescaping is exact. A conversation
has one string; its turns are indivisible, so it is one row however long.

Defined cases: null text or role is empty; null kind is ``message``; a null conv_id is a
conversation of its own; null turns come first, null sequences first within a turn; ties in
sequence go by kind and text; rows repeated exactly both count (a delta twice appends twice); a
turn that was deleted last is not rendered; conversations without turns left are not returned; an
empty log gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: In this order when escaping, in reverse when unescaping.
ESCAPES = (("~", "~0"), ("<", "~1"), ("[", "~2"), ("]", "~3"))
#: Characters of a rendered turn besides its name, twice, and its text; those before the text.
LENGTH, HEAD = len("<s>[][/]</s>"), len("<s>[]")
RESETS = ("message", "edit", "regenerate", "delete")


def escaped(c: Column) -> Column:
    for a, b in ESCAPES:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def unescaped(c: Column) -> Column:
    for a, b in reversed(ESCAPES):
        c = F.replace(c, F.lit(b), F.lit(a))
    return c


def fold(log: DataFrame) -> DataFrame:
    """Log of events -> one row a turn that is left: conv_id, turn, role, text."""
    event = F.struct(
        F.col("seq").cast("long").alias("seq"),
        F.coalesce(F.col("kind"), F.lit("message")).alias("kind"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
        F.coalesce(F.col("role"), F.lit("")).alias("role"),
    )
    turns = log.groupBy("conv_id", "turn").agg(F.array_sort(F.collect_list(event)).alias("e"))
    places = F.filter(F.sequence(F.lit(1), F.size("e")), lambda i: F.element_at(F.col("e"), i)["kind"].isin(*RESETS))
    turns = turns.withColumn("_last", F.coalesce(F.array_max(places), F.lit(1)))
    live = F.slice("e", F.col("_last"), F.size("e"))
    first = F.element_at(live, 1)
    texts = F.transform(live, lambda x: F.when(x["kind"].isin("regenerate", "delete"), F.lit("")).otherwise(x["text"]))
    turns = turns.where(first["kind"] != "delete")
    return turns.select("conv_id", "turn", F.element_at("e", -1)["role"].alias("role"), F.array_join(texts, "").alias("text"))


def render(turns: DataFrame, trained: str = "assistant") -> DataFrame:
    """One row a conversation: conv_id, formatted, loss_spans (start, length of code points; role ``trained``)."""
    name = F.when(F.col("role") == "user", F.lit("INST")).otherwise(F.concat(F.lit("R:"), escaped(F.col("role"))))
    turns = turns.select("conv_id", "turn", name.alias("name"), escaped(F.col("text")).alias("text"), (F.col("role") == trained).alias("loss"))
    turns = turns.withColumn("n", F.length("text")).withColumn("all", F.length("name") * 2 + F.col("n") + LENGTH)
    # The running length, in the shuffle that the grouping needs anyway.
    before = Window.partitionBy("conv_id").orderBy("turn", "name", "text", "loss").rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumn("start", F.coalesce(F.sum("all").over(before), F.lit(0)) + F.length("name") + HEAD)
    chats = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "name", "text", "loss", "start", "n"))).alias("t"))
    whole = lambda x: F.concat(F.lit("<s>["), x["name"], F.lit("]"), x["text"], F.lit("[/"), x["name"], F.lit("]</s>"))
    spans = F.transform(F.filter("t", lambda x: x["loss"]), lambda x: F.struct(x["start"].cast("int").alias("start"), x["n"].cast("int").alias("length")))
    return chats.select("conv_id", F.array_join(F.transform("t", whole), "").alias("formatted"), spans.alias("loss_spans"))


def format_chats(log: DataFrame, trained: str = "assistant") -> DataFrame:
    return render(fold(log), trained)


def read_back(chats: DataFrame) -> DataFrame:
    """Formatted strings -> conv_id, turns (role, text), loss_text; only the strings and spans are used."""
    pieces = F.filter(F.split(F.col("formatted"), "<s>", -1), lambda x: x != "")
    cells = F.transform(pieces, lambda x: F.split(x, r"[\[\]]", -1))  # "", name, text, "/" name, "</s>"
    one = lambda x: F.struct(
        F.when(F.element_at(x, 2) == "INST", F.lit("user")).otherwise(unescaped(F.substring(F.element_at(x, 2), 3, 2**31 - 1))).alias("role"),
        unescaped(F.element_at(x, 3)).alias("text"),
    )
    loss = F.array_join(F.transform("loss_spans", lambda s: unescaped(F.substring(F.col("formatted"), s["start"] + 1, s["length"]))), "")
    return chats.select("conv_id", F.transform(cells, one).alias("turns"), loss.alias("loss_text"), "formatted")


def conversations_log(rows: DataFrame) -> DataFrame:
    """Finished rows (conv_id, turn, role, text) as a log of streamed deltas with a regeneration.

    Each turn becomes: a draft (its first half as a delta), a regenerate event, then the text in two
    deltas cut at the middle; folding gives the row's text again.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    half = F.floor(F.length(text) / 2).cast("int")
    left, right = F.substring(text, F.lit(1), half), F.substring(text, half + 1, F.length(text))
    event = lambda n, kind, x: F.struct(F.lit(n).alias("n"), F.lit(kind).alias("kind"), x.alias("text"))
    events = F.array(event(0, "delta", left), event(1, "regenerate", F.lit("")), event(2, "delta", left), event(3, "delta", right))
    log = rows.select("conv_id", "turn", "role", F.explode(events).alias("x"))
    return log.select("conv_id", "turn", "role", F.col("x.n").alias("seq"), F.col("x.kind").alias("kind"), F.col("x.text").alias("text"))


def op5_chat(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    odd = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", odd), (-1, 1, "assistant", odd)], "conv_id long, turn long, role string, text string")
    rows = rows.select(*[F.col(f.name).cast(f.dataType) for f in more.schema]).unionByName(more)
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))  # repeated turns stay turns of their own
    rows = rows.withColumn("turn", place)
    got = read_back(format_chats(conversations_log(rows)))
    lines = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return got.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP5_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
sized AS (
  SELECT *, length(text) + length(regexp_replace(text, '[^~<\[\]]', '', 'g')) AS n,
         CASE WHEN role = 'user' THEN 4 ELSE 2 + length(role) + length(regexp_replace(role, '[^~<\[\]]', '', 'g')) END AS m FROM rows)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(n + 2 * m + 12) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""
