"""Mixing sources to target weights: every document gets a hash-random key; keys are range-sorted within their source;
distributed prefix sums of sizes find the key at which the source's budget ends.

A source's budget is ``full`` whole epochs and a remainder. Its rows fall into ranges of the key space of about
``RANGE_ROWS`` rows each; the ranges' totals give the range in which the remainder ends, and only that range's rows are
looked at one by one. The outcome, one row a source, is joined back, so texts are never shuffled.

Defined results: a null text has size 0 and is never taken; a null source is a source of its own, last in order; of
rows with the same key, id and text the remainder takes equal shares, rounded down; an empty table gives an empty
result; extra columns stay with ``mix_documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import WORD, stage, word_count

WEIGHTS = (5, 2, 1)
MOST = 3  # times a source's size
RANGE_ROWS = 4096
_KEY_BITS = 60


def source_key(source: Column) -> Column:
    """Null-safe key of a source: text keys start with '=', null is empty."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def random_key(doc_id: Column) -> Column:
    """60 bits of the id's MD5, as a long: random over ids, the same in every run."""
    return F.conv(F.substring(F.md5(F.concat(F.lit("mix:"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 15), 16, 10).cast("long")


def targets(totals: DataFrame) -> DataFrame:
    """skey, source, source_size, n_rows -> with weight and target.

    Targets that stop at MOST sizes, with the excess reshared by weight among the rest, are min(MOST * size,
    level * weight) for one level. In order of MOST * size / weight, the level is what the first source that isn't
    stopped sees: the words not yet given over the weights not yet served. That is the largest over all sources: it rises
    while the sources passed are stopped below it and falls after.
    """
    ordered = totals.withColumn(
        "_w", F.expr(f"element_at(array({', '.join(map(str, WEIGHTS))}), cast(1 + (row_number() over (order by source nulls last) - 1) % {len(WEIGHTS)} as int))").cast("double")
    ).withColumn("_ratio", MOST * F.col("source_size") / F.col("_w"))
    before = "over (order by _ratio, skey rows between unbounded preceding and 1 preceding)"
    levels = ordered.select(
        "*",
        F.expr(f"(sum(source_size) over () - {MOST} * coalesce(sum(source_size) {before}, 0)) / (sum(_w) over () - coalesce(sum(_w) {before}, 0))").alias("_level"),
    )
    return levels.select(
        "skey", "source_size", "n_rows",
        F.expr(f"least(cast({MOST} * source_size as double), _w * max(_level) over ())").alias("target"),
    )


def plan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """(rows, cuts): rows has doc_id, skey, size, key and text hash of every document; cuts has one row a source:
    source_size, target, full, and the key, id and text hash at which the remainder ends with what is left there."""
    rows = stage(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"), source_key(F.col(source_col)).alias("skey"),
            word_count(F.col(text_col)).alias("size"), *_position(id_col, text_col),
        )
    )
    totals = rows.groupBy("skey").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"), F.count("*").alias("n_rows"))
    aims = stage(
        targets(totals)
        .withColumn("_budget", F.floor("target").cast("long"))
        .withColumn("full", F.expr("if(source_size = 0, 0L, _budget div source_size)"))
        .withColumn("_rest", F.col("_budget") - F.col("full") * F.col("source_size"))
        .withColumn("_ranges", F.expr(f"(n_rows + {RANGE_ROWS - 1}) div {RANGE_ROWS}"))
    )
    in_range = rows.join(aims.select("skey", "_rest", "_ranges"), "skey").withColumn("_range", F.expr(f"shiftright(shiftright(key, {_KEY_BITS - 30}) * _ranges, 30)"))
    prefix = "sum({0}) over (partition by skey order by {1} rows unbounded preceding) - {0}"
    hit = (
        in_range.groupBy("skey", "_range", "_rest").agg(F.sum("size").alias("_s"))
        .withColumn("_before", F.expr(prefix.format("_s", "_range")))
        .where("_before <= _rest and _rest < _before + _s")
        .select("skey", F.col("_range").alias("_hit"), (F.col("_rest") - F.col("_before")).alias("_left"))
    )
    cuts = (
        in_range.select("skey", "_range", "key", "_d", "_h", "size").join(hit, "skey").where("_range = _hit")
        .groupBy("skey", "_left", "key", "_d", "_h").agg(F.sum("size").alias("_s"), F.count("*").alias("_n"))
        .withColumn("_before", F.expr(prefix.format("_s", "key, _d, _h")))
        .where("_before <= _left and _left < _before + _s")
        .select("skey", F.struct("key", "_d", "_h").alias("_cut"), F.expr("(_left - _before) div _n").alias("_part"))
    )
    return rows, stage(aims.join(cuts, "skey", "left").select("skey", "source_size", "target", "full", "_cut", "_part"))


def _position(id_col: str, text_col: str) -> list[Column]:
    doc_id = F.col(id_col).cast("long")
    return [random_key(doc_id).alias("key"), F.coalesce(doc_id, F.lit(-(2**63))).alias("_d"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_h")]


def _rest(size: Column) -> Column:
    """Words of the last, incomplete epoch."""
    at = F.struct("key", "_d", "_h")
    return F.when(F.col("_cut").isNull(), F.lit(0)).when(at < F.col("_cut"), size).when(at == F.col("_cut"), F.col("_part")).otherwise(F.lit(0)).cast("long")


def taken(docs: DataFrame, **cols: str) -> DataFrame:
    """doc_id, size, source_size, target and taken (words of the mix from this row, repeats counted) of every row."""
    rows, cuts = plan(docs, **cols)
    size = F.col("size")
    return rows.join(cuts, "skey").select("doc_id", "size", "source_size", "target", (F.col("full") * size + _rest(size)).alias("taken"))


def mix_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: each row of ``docs`` once for every whole epoch and once more in the last, there cut behind the
    word at which the source's budget ends."""
    _, cuts = plan(docs, id_col=id_col, text_col=text_col, source_col=source_col)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    size = word_count(F.col(f"_row.`{text_col}`"))
    sized = docs.select(row, source_key(F.col(source_col)).alias("skey"), *_position(id_col, text_col)).join(cuts.select("skey", "full", "_cut", "_part"), "skey")
    # sizes are only needed at the cut, where _part says how many words stay
    whole = F.when(F.col("_cut").isNotNull() & (F.struct("key", "_d", "_h") < F.col("_cut")), 1).otherwise(0)
    part = F.when(F.struct("key", "_d", "_h") == F.col("_cut"), F.col("_part")).otherwise(F.lit(0))
    copies = sized.select("_row", (F.col("full") + whole).cast("int").alias("_times"), F.coalesce(part, F.lit(0)).alias("_words"))
    words_in = copies.where("_times > 0").where(size > 0).select("_row", F.explode(F.expr("array_repeat(-1L, _times)")).alias("_words"))
    cut_off = copies.where("_words > 0").select("_row", "_words")
    text = F.col(f"_row.`{text_col}`")
    head = F.when(F.col("_words") < 0, text).otherwise(F.array_join(F.slice(F.regexp_extract_all(text, F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0)), F.lit(1), F.col("_words").cast("int")), ""))
    out = []
    for c in docs.columns:
        col = F.col(f"_row.`{c}`")
        if c == text_col:
            col = head
        elif c == "n_chars":
            col = F.when(F.col("_words") < 0, col).otherwise(F.length(head)).cast(docs.schema[c].dataType)
        out.append(col.alias(c))
    return words_in.unionByName(cut_off).select(*out)


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    substr(md5('mix:' || doc_id), 1, 15) AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS w FROM s),
r AS (SELECT *, 3 * source_size / w AS ratio FROM w),
l AS (
  SELECT *, ((sum(source_size) OVER ()) - 3 * coalesce(sum(source_size) OVER before, 0))
    / ((sum(w) OVER ()) - coalesce(sum(w) OVER before, 0)) AS level
  FROM r WINDOW before AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least((3 * source_size)::DOUBLE,
    w * max(level) OVER ()) AS target FROM l),
b AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE floor(target)::BIGINT // source_size END AS full_epochs FROM t),
p AS (
  SELECT d.*, (sum(size) OVER (PARTITION BY source ORDER BY key, doc_id ROWS UNBOUNDED PRECEDING) - size) AS before FROM d)
SELECT p.doc_id, p.size, b.source_size, b.target, (b.full_epochs * p.size
  + greatest(0, least(p.size, floor(b.target)::BIGINT - b.full_epochs * b.source_size - p.before)))::BIGINT AS taken
FROM p JOIN b ON p.source IS NOT DISTINCT FROM b.source
"""
