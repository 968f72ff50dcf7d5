"""Mixing sources to target weights by weighted fair queueing (operator 11).

1. A document's size is its number of words. Sources, in the order of their code points with null last, get the weights in turn.
   They share BUDGET of all sizes by weight; a source whose share would exceed MOST times its size gets just that, and the rest is
   shared again until no share does: an aggregate over the sources a round, each of which settles at least one source.
2. Within its source every document has a place by a keyed digest of its doc_id (the shuffle), and a running total of the words up
   to it. Its virtual finish time is that total divided by the source's target; the repeat of a document finishes a whole source
   later. Running totals are prefix sums over ranges of (source, digest), so a source is never in one task.
3. All finish times are sorted in ranges and truncated where the running total reaches the budget: one entry is the cut. A
   document's words are taken for each of its entries before the cut; the entry at the cut gives the words that are left.

A source takes its target but for the words of one document, more or less. Digests and totals are exact, so reruns agree.

Nulls and ties: a text of null has size 0; a null source is a source of its own, apart from the empty text. Documents without words
take nothing. Null doc_ids share a digest; rows with equal doc_id are told apart by size, and equal rows are interchangeable. An
empty table gives no rows; without any word every target is 0. Extra columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranks import numbered, running_total
from .common import materialize, scratch, table

WEIGHTS = (5, 2, 1)
#: The budget is 3 / 2 of all words, and a source or document gives at most twice its own.
BUDGET, MOST = (3, 2), 2


def word_count(text: Column) -> Column:
    """Number of words: each, with the white space at its sides, becomes one letter, so no array of words is made."""
    space = "\\x20\\x09-\\x0D"
    marks = F.length(F.regexp_replace(text, f"[{space}]*+[^{space}]++[{space}]*+", "x"))
    return F.coalesce(F.when(text.rlike(f"[^{space}]"), marks), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, path: str, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """source, i (its place), source_size, start (words of the sources before it), target of each source of (source, size)."""
    each = materialize(sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("last", F.col("source").isNull()), f"{path}/each")
    placed = running_total(numbered(each, ["last", "source"]), ["i"], F.col("source_size"), "start")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("i") % len(weights) + 1).cast("int"))
    sources = materialize(placed.select("source", "i", "source_size", "start", weight.cast("long").alias("w")), f"{path}/weighed")
    cap, full, shared = MOST * F.col("source_size"), F.lit(False), -1
    total = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    num, den = 0, 1
    while True:
        capped, open_weight, n = sources.agg(F.coalesce(F.sum(F.when(full, cap)), F.lit(0)), F.coalesce(F.sum(F.when(~full, F.col("w"))), F.lit(0)), F.count_if(full)).first()
        if n == shared or not open_weight:
            break
        num, den, shared = BUDGET[0] * total - BUDGET[1] * capped, BUDGET[1] * open_weight, n
        share = (F.col("w") * F.lit(num)).cast("double") / F.lit(float(den))
        full = cap.cast("double") < share
    share = (F.col("w") * F.lit(num)).cast("double") / F.lit(float(den))
    return sources.select("source", "i", "source_size", "start", F.least(cap.cast("double"), share).alias("target"))


def mix_sources(docs: DataFrame, path: str, weights: tuple[int, ...] = WEIGHTS, seed: str = "mix") -> DataFrame:
    """Per row of docs (doc_id, text, source): doc_id, source, size, source_size, target, taken (words, repeats counted)."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    sizes = materialize(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), digest.alias("digest")), f"{path}/sizes")
    sources = materialize(source_targets(sizes, path, weights), f"{path}/sources")
    named = sources.withColumnRenamed("source", "_source")
    each = sizes.join(named, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    each = running_total(each, ["i", "digest", "doc_id", "size"], F.col("size"))
    total = (F.col("before") - F.col("start") + F.col("size")).alias("total")
    each = materialize(each.select("doc_id", "source", "i", "size", "source_size", "target", total), f"{path}/totals")

    def entries(k):
        """Finish time, source and running total of the k-th repeat; together unique among documents with words."""
        at = F.col("total") + k * F.col("source_size")
        return F.struct((at.cast("double") / F.col("target")).alias("finish"), F.col("i").alias("i"), at.alias("at"))

    queue = each.where("size > 0").select("size", F.explode(F.array(*map(entries, range(MOST)))).alias("e")).select("e.*", "size")
    words = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0] * BUDGET[0] // BUDGET[1]
    ahead = running_total(queue, ["finish", "i", "at"], F.col("size"))
    cut = ahead.where((F.col("before") < words) & (F.col("before") + F.col("size") >= words)).first()
    if cut is None:
        return each.select("doc_id", "source", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"))
    last = F.struct(F.lit(cut.finish).alias("finish"), F.lit(cut.i).cast(each.schema["i"].dataType).alias("i"), F.lit(cut["at"]).cast("long").alias("at"))
    taken = sum((F.when(entries(k) < last, F.col("size")).when(entries(k) == last, F.lit(words - cut.before)).otherwise(0) for k in range(MOST)), F.lit(0))
    return each.select("doc_id", "source", "size", "source_size", "target", F.when(F.col("size") > 0, taken).otherwise(0).cast("long").alias("taken"))


def op11_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: all documents, weights 5, 2, 1 in turn, 150 % of all words."""
    return mix_sources(table(spark, sf_dir, "documents"), scratch(spark, "op11")).drop("source")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS digest,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), s AS (
  SELECT *, row_number() OVER o - 1 AS i, CASE (row_number() OVER o - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w
  FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source)
  WINDOW o AS (ORDER BY source IS NULL, source COLLATE "C")
), r AS (
  SELECT *, row_number() OVER (ORDER BY CAST(2 * source_size AS DOUBLE) / w, i) AS k, sum(source_size) OVER () AS t,
         coalesce(sum(2 * source_size) OVER before, 0) AS capped, sum(w) OVER from_here AS open_w FROM s
  WINDOW before AS (ORDER BY CAST(2 * source_size AS DOUBLE) / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         from_here AS (ORDER BY CAST(2 * source_size AS DOUBLE) / w, i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
), level AS (
  SELECT CAST(3 * t - 2 * capped AS BIGINT) AS num, CAST(2 * open_w AS BIGINT) AS den FROM r
  WHERE CAST(2 * source_size AS DOUBLE) >= CAST(w * (3 * t - 2 * capped) AS DOUBLE) / CAST(2 * open_w AS DOUBLE) ORDER BY k LIMIT 1
), g AS (
  SELECT source, i, source_size, least(CAST(2 * source_size AS DOUBLE), CAST(w * num AS DOUBLE) / CAST(den AS DOUBLE)) AS target FROM s, level
), c AS (
  SELECT doc_id, size, i, source_size, target, sum(size) OVER (PARTITION BY i ORDER BY digest, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) AS total, row_number() OVER () AS n
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source
), q AS (
  SELECT n, size, sum(size) OVER (ORDER BY finish, i, upto ROWS UNBOUNDED PRECEDING) - size AS before
  FROM (SELECT n, size, i, CAST(total AS DOUBLE) / target AS finish, total AS upto FROM c WHERE size > 0
        UNION ALL SELECT n, size, i, CAST(total + source_size AS DOUBLE) / target, total + source_size FROM c WHERE size > 0)
), x AS (
  SELECT n, sum(greatest(0, least(size, (SELECT sum(size) * 3 // 2 FROM d) - before))) AS taken FROM q GROUP BY n
)
SELECT doc_id, size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken FROM c LEFT JOIN x USING (n)
"""
