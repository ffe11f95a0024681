"""Mixing sources to target weights: hash-random order, distributed prefix sums, exact budgets.

Every row gets a pseudo-random key (md5 of seed and id). Within a source rows are ordered by that
key, token counts are summed up to each row, and the order is cut exactly at the source's budget;
a budget beyond the source's size runs whole epochs first. DataFrame functions only.

``mixed_rows`` makes the mixed corpus without moving a text: the cut row of each source is found on a
table of keys and sizes, and one scan of the documents compares every row's key with it.

Defined cases: null text has size 0; a null source is a source of its own, last in order; null ids
share a key of their own; rows alike in id, source and size are interchangeable; an empty table gives
an empty result; a source of size 0 has target 0. ``mix_sources`` ignores other columns, ``mixed_rows``
carries them, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _scale

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text):
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most_epochs: int = 3) -> DataFrame:
    """``sizes`` (_g, source_size), one row a source -> with target.

    The capped shares have a closed form: by rising cap / weight, the first source whose cap holds
    the common level fixes that level for all after it; those before stop at their caps.
    """
    order = Window.orderBy("_g")
    w = F.element_at(F.array(*[F.lit(int(x)) for x in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")).cast("long")
    rising = Window.orderBy(F.col("_cap") / F.col("_w"), "_g")
    every = Window.partitionBy(F.lit(0))
    df = sizes.withColumn("_w", w).withColumn("_cap", F.col("source_size") * most_epochs)
    df = df.withColumn("_all", F.sum("source_size").over(every))
    df = df.withColumn("_caps", F.coalesce(F.sum("_cap").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    df = df.withColumn("_ws", F.sum("_w").over(rising.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    df = df.withColumn("_level", (F.col("_all") - F.col("_caps")).cast("double") / F.col("_ws").cast("double"))
    top = F.max(F.when(F.col("_cap").cast("double") / F.col("_w").cast("double") >= F.col("_level"), F.col("_level"))).over(every)
    df = df.withColumn("_top", top)
    target = F.when(F.col("_top").isNull(), F.col("_cap").cast("double")).otherwise(F.least(F.col("_cap").cast("double"), F.col("_top") * F.col("_w").cast("double")))
    return df.select("_g", "source_size", target.alias("target"))


def group_key(source):
    """A source as a string that is never null and sorts nulls last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source.cast("string")))


def row_key(row_id, seed: str):
    return F.md5(F.concat(F.lit(seed), F.coalesce(row_id.cast("string"), F.lit("null"))).cast("binary"))


def placed(rows: DataFrame, ties: list[str], weights: tuple[int, ...], most_epochs: int) -> DataFrame:
    """``rows`` (_g, _key, size, and others) with source_size, target, _epochs (whole rounds), _rest (words of the last
    round) and _start (words of the source before the row)."""
    rows = _scale.saved(rows, "sizes")
    shares = targets(rows.groupBy("_g").agg(F.sum("size").alias("source_size")), weights, most_epochs)
    out = _scale.prefix_sums(rows, "_g", "_key", [*ties, "size"], F.col("size"), _scale.bits_for(rows.count()), "_start", shares)
    budget = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    return out.withColumn("_epochs", epochs).withColumn("_rest", budget - F.col("_epochs") * F.col("source_size"))


def mix_sources(docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: tuple[int, ...] = (1, 2, 3), most_epochs: int = 3, seed: str = "mix-") -> DataFrame:
    """-> id, source, size, source_size, target, taken (words, repeats counted)."""
    rows, name = _scale.positional(docs)
    row_id, source, text = (F.col(name[c]) for c in (id_col, source_col, text_col))
    rows = rows.select(row_id.alias("_id"), group_key(source).alias("_g"), row_key(row_id, seed).alias("_key"), word_count(text).alias("size"))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("_rest") - F.col("_start")))
    return placed(rows, ["_id"], weights, most_epochs).select(
        F.col("_id").alias(id_col),
        F.when(F.col("_g") == "1", F.lit(None).cast("string")).otherwise(F.substring(F.col("_g"), 2, 2**31 - 1)).alias(source_col),
        "size", "source_size", "target",
        (F.col("_epochs") * F.col("size") + part).cast("long").alias("taken"),
    )


def mixed_rows(docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: tuple[int, ...] = (1, 2, 3), most_epochs: int = 3, seed: str = "mix-") -> DataFrame:
    """The mixed corpus itself: every row as often as it is taken, the cut row with its first words only.

    Rows with nothing taken go; wordless rows have nothing to take and go with them. Rows alike in id
    and text are told apart only where the cut falls among them.
    """
    columns = docs.columns
    rows, name = _scale.positional(docs)
    row_id, source, text = (F.col(name[c]) for c in (id_col, source_col, text_col))
    rows = rows.withColumn("_g", group_key(source)).withColumn("_key", row_key(row_id, seed)).withColumn("_tie", F.xxhash64(F.coalesce(text, F.lit(""))))
    got = _scale.saved(placed(rows.select("_g", "_key", "_tie", word_count(text).alias("size")), ["_tie"], weights, most_epochs), "placed")
    # The row in which each source's last round ends, and its like.
    here = (F.col("_start") <= F.col("_rest")) & (F.col("_rest") < F.col("_start") + F.col("size"))
    cut = F.min(F.when(here, F.struct("_key", "_tie", "_start")))
    cuts = got.groupBy("_g").agg(F.first("_epochs").alias("_epochs"), F.first("_rest").alias("_rest"), cut.alias("_cut")).where(F.col("_cut").isNotNull())
    cuts = _scale.saved(cuts.select("_g", "_epochs", F.col("_cut._key").alias("_k"), F.col("_cut._tie").alias("_t"), F.col("_cut._start").alias("_s"), (F.col("_rest") - F.col("_cut._start")).cast("int").alias("_part")), "cuts")
    like = got.join(_scale.bounded(cuts), "_g").where((F.col("_key") == F.col("_k")) & (F.col("_tie") == F.col("_t"))).groupBy("_g")
    like = _scale.saved(like.agg(F.count(F.lit(1)).alias("_like"), F.sum((F.col("_start") < F.col("_s")).cast("long")).alias("_whole")), "like")
    cuts = _scale.bounded(_scale.saved(cuts.join(like, "_g").drop("_s"), "cuts"))
    rows = rows.where(F.coalesce(text.rlike(WORD), F.lit(False))).join(cuts, "_g")
    before = F.struct("_key", "_tie") < F.struct(F.col("_k").alias("_key"), F.col("_t").alias("_tie"))
    same = (F.col("_key") == F.col("_k")) & (F.col("_tie") == F.col("_t"))
    nth = F.lit(0).cast("long")
    if like.where("_like > 1").limit(1).count():
        # Rows alike in id and text on both sides of the cut are numbered; a hot one is numbered over many tasks.
        among = same & (F.col("_like") > 1)
        alike = _scale.saved(rows.where(among).withColumn("_nth_key", F.md5(F.monotonically_increasing_id().cast("string"))), "alike")
        alike = _scale.prefix_sums(alike, "_g", "_nth_key", [], F.lit(1), _scale.bits_for(alike.count()), "_nth").drop("_nth_key")
        rows = rows.where(~among).withColumn("_nth", nth).unionByName(alike)
        nth = F.col("_nth")
    more = (before | same & (nth < F.col("_whole"))).cast("int")
    end = F.when(same & (nth == F.col("_whole")) & (F.col("_part") > 0), F.array("_part")).otherwise(F.array().cast("array<int>"))
    rows = rows.withColumn("_to", F.explode(F.concat(F.array_repeat(F.lit(-1), (F.col("_epochs") + more).cast("int")), end)))
    whole = F.col("_to") < 0
    first = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(f"({WORD})")), 1, F.greatest(F.col("_to"), F.lit(0))), " ")
    out = {c: F.col(k) for c, k in name.items()}
    out[text_col] = F.when(whole, text).otherwise(first)
    if "n_chars" in columns:
        out["n_chars"] = F.when(whole, out["n_chars"]).otherwise(F.length(out[text_col]).cast(docs.schema["n_chars"].dataType))
    return rows.select(*[out[c].alias(c) for c in columns])


def op3_mix(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")


OP3_SQL = r"""
WITH base AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS g,
         md5('mix-' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS k,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
sizes AS (SELECT g, CAST(sum(size) AS BIGINT) AS source_size FROM base GROUP BY g),
weighed AS (
  SELECT g, source_size, 3 * source_size AS cap, 1 + (row_number() OVER (ORDER BY g) - 1) % 3 AS w,
         sum(source_size) OVER () AS total FROM sizes),
levels AS (
  SELECT *, CAST(total - coalesce(sum(cap) OVER (ORDER BY CAST(cap AS DOUBLE) / w, g ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
          / CAST(sum(w) OVER (ORDER BY CAST(cap AS DOUBLE) / w, g ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level FROM weighed),
topped AS (SELECT *, max(CASE WHEN CAST(cap AS DOUBLE) / CAST(w AS DOUBLE) >= level THEN level END) OVER () AS top FROM levels),
shares AS (
  SELECT g, source_size, CASE WHEN top IS NULL THEN CAST(cap AS DOUBLE) ELSE least(CAST(cap AS DOUBLE), top * CAST(w AS DOUBLE)) END AS target FROM topped),
placed AS (
  SELECT b.doc_id, b.size, s.source_size, s.target, CAST(round(s.target) AS BIGINT) AS budget,
         coalesce(sum(b.size) OVER (PARTITION BY b.g ORDER BY b.k, b.doc_id, b.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM base b JOIN shares s USING (g)),
cut AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM placed)
SELECT doc_id, size, source_size, target,
       CAST(epochs * size + greatest(0, least(size, budget - epochs * source_size - start)) AS BIGINT) AS taken FROM cut
"""
