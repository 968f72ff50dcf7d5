"""Interaction of document filters: what each removes in every order of application (operator 12).

1. One pass over the texts gives each document the letters of the filters A to D that it fails (see FILTERS), its length in code
   points and a hash of each of its blocks, which grow sixteenfold and cover the whole text.
2. Filter E, duplicates, by refinement of a partition: documents are split by length, then by the hash of one block after the
   other, and whatever is alone in its part is dropped. Only these narrow rows are split. The texts of those left are compared in
   full, and of equal texts all but the smallest doc_id are marked.
3. Documents are counted by language and by the set of filters that they fail: at most 32 rows a language. Orders and steps are
   derived from these counts alone.

Nulls and ties: null texts are empty ones, a null lang is the empty one. Rows without doc_id are never marked as duplicates and
mark none; rows with one doc_id and one text aren't smaller than each other. Of several labels of a doc_id any 1 counts. An empty
table gives no rows. Texts may be of any length; extra columns are not looked at.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bounded_batches, materialize, partition_end, scratch, table

#: A: few words; B: few distinct ones; C: many capitals; D: symbols; E: a duplicate.
FILTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT_PCT, MAX_CAPITALS_PCT, SYMBOLS = 200, 50, 3, b"#$%&*|"
#: Code points at which a text's blocks begin; the last one has no end.
STARTS = (0, 1 << 10, 1 << 14, 1 << 18, 1 << 22, 1 << 26)
_CAPITALS, _FOLLOWING = bytes(range(65, 91)), bytes(range(0x80, 0xC0))
#: Bytes of a text whose words are split at a time.
_PART = 1 << 20


def failed_filters(data: bytes) -> str:
    """The letters of the filters A to D that a text in UTF-8 fails."""
    words, distinct, at = 0, set(), 0
    while at < len(data):
        end = at + _PART
        while end < len(data) and data[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        part = data[at:end].split()
        words += len(part)
        distinct.update(part)
        at = end
    points = len(data) - (0 if data.isascii() else len(data) - len(data.translate(None, _FOLLOWING)))
    fails = "A" if words < MIN_WORDS else ""
    fails += "B" if 100 * len(distinct) < MIN_DISTINCT_PCT * words else ""
    fails += "C" if 100 * (len(data) - len(data.translate(None, _CAPITALS))) > MAX_CAPITALS_PCT * points else ""
    return fails + ("D" if any(c in data for c in SYMBOLS) else "")


def _digested(docs: DataFrame, hashed=F.xxhash64) -> DataFrame:
    """doc_id, part, text, n (code points), a hash for each block (0 beyond the text) and c, a hash of all of them."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("part"), text.alias("text"), F.length(text).cast("long").alias("n"))
    for k, (start, end) in enumerate(zip(STARTS, [*STARTS[1:], (1 << 31) - 1])):
        block = hashed(F.substring("text", start + 1, end - start))
        rows = rows.withColumn(f"h{k}", F.when(F.col("n") > start, block).otherwise(F.lit(0)).cast("long"))
    return rows.withColumn("c", hashed(*[f"h{k}" for k in range(len(STARTS))]).cast("long"))


def _facts(rows: DataFrame) -> DataFrame:
    """The same without the text, with ``fails``."""

    def run(batches):
        import pyarrow as pa

        try:
            for b in batches:
                fails = pa.array([failed_filters(x.as_py()) for x in b.column("text").cast(pa.binary())], pa.string())
                keep = [c for c in b.schema.names if c != "text"]
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), fails], names=[*keep, "fails"])
        finally:
            partition_end()

    bounded_batches(rows.sparkSession)
    return rows.mapInArrow(run, rows.drop("text").withColumn("fails", F.lit("")).schema)


def repeated_texts(docs: DataFrame, facts: DataFrame, path: str, hashed=F.xxhash64) -> DataFrame:
    """doc_id, n, c of the rows whose text also has a smaller doc_id."""
    longest = facts.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    left, key = facts.where("doc_id IS NOT NULL").select("doc_id", "n", *[f"h{k}" for k in range(len(STARTS))], "c"), ["n"]
    for k in range(-1, len(STARTS)):
        if k >= 0:
            if longest <= STARTS[k]:
                break
            key.append(f"h{k}")
        shared = materialize(left.groupBy(*key).agg(F.count("*").alias("m")).where("m > 1").drop("m"), f"{path}/shared-{k + 1}")
        left = materialize(left.join(shared, key, "left_semi"), f"{path}/left-{k + 1}")
    left = left.select("doc_id", "n", "c")
    # by merging at every size: all texts are shuffled once, those that share nothing are dropped before they are grouped
    texts = _digested(docs, hashed).select("doc_id", "n", "c", "text").join(left.distinct().hint("merge"), ["doc_id", "n", "c"], "left_semi")
    classes = materialize(texts.groupBy("n", "c", "text").agg(F.min("doc_id").alias("first")), f"{path}/classes")
    count = materialize(classes.groupBy("n", "c").agg(F.count("*").alias("texts"), F.min("first").alias("first")), f"{path}/count")
    found = left.join(count.where("texts = 1"), ["n", "c"]).select("doc_id", "n", "c", "first")
    clashes = count.where("texts > 1").select("n", "c")
    if not clashes.isEmpty():  # different texts with equal hashes of all blocks: found by the text itself
        found = found.unionByName(texts.join(classes.join(clashes, ["n", "c"], "left_semi"), ["n", "c", "text"]).select("doc_id", "n", "c", "first"))
    return found.where("doc_id > first").select("doc_id", "n", "c").distinct()


def interactions(counts: DataFrame) -> DataFrame:
    """All orders and steps of each part from its counts (part, fails, n, good, toxic)."""
    orders = F.explode(F.split(F.lit(" ".join(map("".join, permutations(FILTERS)))), " "))
    each = counts.withColumn("filter_order", orders).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    each = each.withColumn("filter", F.expr("substring(filter_order, step, 1)"))
    gone = F.expr("translate(substring(filter_order, 1, step - 1), fails, '') <> substring(filter_order, 1, step - 1)")
    failing = F.expr("contains(fails, filter)")

    def total(condition: Column, column: str, name: str) -> Column:
        return F.sum(F.when(condition, F.col(column)).otherwise(F.lit(0))).cast("long").alias(name)

    steps = each.groupBy("part", "filter_order", "step", "filter").agg(
        total(~gone & ~failing, "n", "kept"), total(~gone & failing, "n", "removed"), total(gone & failing, "n", "redundant"),
        total(F.expr("fails = filter"), "n", "unique_fails"), total(~gone & failing, "good", "good_lost"), total(~gone & failing, "toxic", "toxic_lost"),
    )
    return steps.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "filter"))).drop("filter")


def filter_audit(docs: DataFrame, labels: DataFrame, path: str, hashed=F.xxhash64) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley of docs (doc_id, text, lang)."""
    facts = materialize(_facts(_digested(docs, hashed)), f"{path}/facts")
    repeated = materialize(repeated_texts(docs, facts, path, hashed), f"{path}/repeated")
    marked = facts.select("doc_id", "part", "fails", "n", "c").join(repeated.withColumn("e", F.lit("E")), ["doc_id", "n", "c"], "left")
    flags = labels.where("quality = 1 OR toxic = 1").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    flags = flags.agg(*[F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(name) for c, name in (("quality", "good"), ("toxic", "toxic"))])
    known = marked.join(flags, "doc_id", "left").groupBy("part", F.concat("fails", F.coalesce("e", F.lit(""))).alias("fails"))
    counts = known.agg(F.count("*").alias("n"), *[F.sum(F.coalesce(c, F.lit(0))).cast("long").alias(c) for c in ("good", "toxic")])
    return interactions(materialize(counts, f"{path}/counts"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: the five filters over all documents."""
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), scratch(spark, "op12"))


ORACLE = r"""
WITH t AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), f AS (
  SELECT doc_id, part, [len(words) < 200, 100 * len(list_distinct(words)) < 50 * len(words),
         100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text), regexp_matches(text, '[#$%&*|]'),
         coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)] AS fails FROM t
), c AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)) AS good,
         count(*) FILTER (WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)) AS toxic FROM f GROUP BY part, fails
), l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), o AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a, l b, l c, l d, l e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), s AS (
  SELECT filter_order, step, substr(filter_order, step, 1) AS filter, ascii(substr(filter_order, step, 1)) - 64 AS place,
         list_transform(string_split(substr(filter_order, 1, step - 1), ''), lambda x: ascii(x) - 64) AS earlier
  FROM o, (SELECT CAST(unnest([1, 2, 3, 4, 5]) AS INTEGER) AS step)
), e AS (
  SELECT part, filter_order, step, filter, n, good, toxic, fails[place] AS failing, len(list_filter(earlier, lambda p: p > 0 AND fails[p])) > 0 AS gone,
         fails[place] AND len(list_filter(fails, lambda b: b)) = 1 AS alone FROM c, s
), r AS (
  SELECT part, filter_order, step, filter, CAST(coalesce(sum(n) FILTER (WHERE NOT gone AND NOT failing), 0) AS BIGINT) AS kept,
         CAST(coalesce(sum(n) FILTER (WHERE NOT gone AND failing), 0) AS BIGINT) AS removed, CAST(coalesce(sum(n) FILTER (WHERE gone AND failing), 0) AS BIGINT) AS redundant,
         CAST(coalesce(sum(n) FILTER (WHERE alone), 0) AS BIGINT) AS unique_fails, CAST(coalesce(sum(good) FILTER (WHERE NOT gone AND failing), 0) AS BIGINT) AS good_lost,
         CAST(coalesce(sum(toxic) FILTER (WHERE NOT gone AND failing), 0) AS BIGINT) AS toxic_lost
  FROM e GROUP BY part, filter_order, step, filter
)
SELECT * EXCLUDE (filter), CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley FROM r
"""
