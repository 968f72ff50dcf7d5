"""Divergence of sources within a language, from a vocabulary counted in two passes (operator 13).

1. First pass: the exact number of documents that hold each term, by language. Every task counts in bounded dictionaries, so Spark
   shuffles a row per task and term at most. Terms in at least MIN_DOCS documents of a language are kept for it.
2. The kept terms are dealt into decks of DECK_CHARS characters and written, a folder each; a document knows which decks are its
   language's. Second pass: the terms of a deck, with a delimiter at either side, make an Aho-Corasick automaton that recounts
   their occurrences in each source's texts, whose delimiters are all alike by then. A worker holds a bounded number of decks.
3. The counts are sparse postings (lang, source, term, n). A probability is p = 1 + floor(SCALE * (n + 5) / (N + 5 * V)), in whole
   numbers throughout; a source without the term has the same floor p for all such terms.
4. Pairs of sources: postings go to (chunk of terms, two blocks of sources) and are summed there; terms that neither block has
   count at once. So no row is made for a pair and term, and no task holds more than two blocks and a chunk.
5. Terms that a source has more often than its language are ranked within it, the first TOP of them.

Nulls and ties: null text, lang and source are empty ones; repeated rows count as often as they come; equal values rank by the bytes
of the item. A language without kept terms has pairs of value 0. An empty table gives no rows. Long texts are scanned in parts that
end between terms. Extra columns are not looked at.
"""

from __future__ import annotations

from collections import Counter, OrderedDict, defaultdict
from operator import itemgetter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.ranks import running_total
from .common import bounded_batches, materialize, open_fs, partition_end, scratch, table

MIN_DOCS, SMOOTH, SCALE, TOP = 30, 5, 1_000_000_000, 50
#: Characters of a deck's terms; decks that a worker holds; entries that a task counts before it hands them on.
DECK_CHARS, DECKS_HELD, ENTRIES = 1_000_000, 4, 400_000
#: Bytes of text that are scanned together, and sources and terms of a block of pairs.
SCAN_BYTES, SOURCES, CHUNK = 4 << 20, 64, 512
#: Every byte but letters and parts of longer code points becomes a space; A to Z become lower case.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def term_parts(data: bytes, size: int = SCAN_BYTES):
    """A text in parts of about ``size`` bytes that end between terms, folded, with single delimiters."""
    data, at = data.translate(_FOLD), 0
    while at < len(data):
        end = at + size
        if end < len(data):
            end = data.find(b" ", end)
            end = len(data) if end < 0 else end
        yield data[at:end]
        at = end


def _map_arrow(df: DataFrame, rows, schema: str) -> DataFrame:
    """rows: from an iterator of columns as lists (strings as bytes) to lists of rows."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kind = StructType.fromDDL(schema)
    arrow = to_arrow_schema(kind)

    def run(batches):
        import pyarrow as pa

        def columns():
            for b in batches:
                yield [(c.cast(pa.binary()) if pa.types.is_string(c.type) else c).to_pylist() for c in b.columns]

        try:
            for out in rows(columns()):
                cols = list(zip(*out)) or [[] for _ in arrow]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()).cast(pa.string()) if pa.types.is_string(f.type) else pa.array(c, f.type) for c, f in zip(cols, arrow)], schema=arrow)
        finally:
            partition_end()

    bounded_batches(df.sparkSession)
    return df.mapInArrow(run, kind)


def document_counts(docs: DataFrame) -> DataFrame:
    """lang, term, n: the number of rows of docs (lang, text) that hold the term."""

    def count(columns):
        found, entries = defaultdict(Counter), 0
        for langs, texts in columns:
            for lang, text in zip(langs, texts):
                terms = set()
                for part in term_parts(text):
                    terms.update(part.split())
                of = found[lang]
                entries -= len(of)
                of.update(terms)
                entries += len(of)
                if entries > ENTRIES:
                    for lang, of in found.items():
                        yield [(lang, t, n) for t, n in of.items()]
                    found, entries = defaultdict(Counter), 0
        for lang, of in found.items():
            yield [(lang, t, n) for t, n in of.items()]

    return _map_arrow(docs.select("lang", "text"), count, "lang string, term string, n long").groupBy("lang", "term").agg(F.sum("n").alias("n"))


def load_deck(folder: str):
    """The automaton of a deck's terms, each between two delimiters, and the terms by number."""
    import ahocorasick
    import pyarrow.parquet as pq

    fs, path = open_fs(folder)
    terms = pq.ParquetDataset(path, filesystem=fs, partitioning=None).read(columns=["term"]).column("term").to_pylist()
    automaton = ahocorasick.Automaton()
    for i, t in enumerate(terms):
        automaton.add_word(f" {t} ", i)
    automaton.make_automaton()
    return automaton, [t.encode() for t in terms]


def occurrences(docs: DataFrame, decks: str) -> DataFrame:
    """lang, source, term, n: occurrences of kept terms in docs (lang, source, text, first, decks: the numbers of the lang's decks)."""

    def recount(columns):
        held, number = OrderedDict(), itemgetter(1)
        found, entries, waiting, size = defaultdict(Counter), 0, defaultdict(list), 0

        def deck(n):
            if n not in held:
                while len(held) >= DECKS_HELD:
                    held.popitem(last=False)
                held[n] = load_deck(f"{decks}/deck={n}")
            held.move_to_end(n)
            return held[n]

        def scan():
            nonlocal entries
            for lang, source, first, n in sorted(waiting):
                text = b" ".join([b"", *waiting[lang, source, first, n], b""]).decode("utf-8", "replace")
                for k in range(first, first + n):
                    of = found[lang, source, k]
                    entries -= len(of)
                    of.update(map(number, deck(k)[0].iter(text)))
                    entries += len(of)
            waiting.clear()

        def counted():
            for (lang, source, k), of in sorted(found.items(), key=lambda x: x[0][2]):
                terms = deck(k)[1]
                yield [(lang, source, terms[i], n) for i, n in of.items()]
            found.clear()

        for batch in columns:
            for lang, source, text, first, n in zip(*batch):
                for part in term_parts(text):
                    waiting[lang, source, first, n].append(part)
                    size += len(part)
                    if size >= SCAN_BYTES:
                        scan()
                        size = 0
                        if entries > ENTRIES:
                            yield from counted()
                            entries = 0
        scan()
        yield from counted()

    each = _map_arrow(docs.select("lang", "source", "text", "first", "decks"), recount, "lang string, source string, term string, n long")
    return each.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"))


def probability(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (n + SMOOTH) / (total + SMOOTH * terms)) in whole numbers: SCALE is divided out in steps of 1000."""
    top, low, p = n + SMOOTH, total + SMOOTH * terms, F.lit(0).cast("long")
    for _ in range(3):
        p = p * 1000 + F.floor(F.call_function("div", top * 1000, low))
        top = (top * 1000) % low
    return (p + 1).cast("long")


def _pair_sums(postings: DataFrame, groups: DataFrame, langs: DataFrame, kept: DataFrame, path: str) -> DataFrame:
    """lang, a, b (a < b) and value, the sum of differences over all kept terms, of postings (lang, source, term, p)."""
    dealt = langs.withColumn("chunks", F.ceil(F.greatest(F.col("v"), F.lit(1)) / CHUNK)).withColumn("blocks", F.ceil(F.col("sources") / SOURCES))
    place = {"chunk": F.pmod(F.xxhash64("term"), F.col("chunks")), "block": F.pmod(F.xxhash64("source"), F.col("blocks"))}
    dealt = materialize(dealt.select("lang", "chunks", "blocks"), f"{path}/dealt")
    width = materialize(kept.join(dealt, "lang").groupBy("lang", place["chunk"].alias("chunk")).agg(F.count("*").alias("width")), f"{path}/width")
    # a row without a term for each source and chunk: the source's floor and the number of terms of the chunk
    all_chunks = groups.join(dealt, "lang").withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    floors = all_chunks.join(width, ["lang", "chunk"], "left").select("lang", "chunk", place["block"].alias("block"), "blocks", "source", F.lit(None).cast("string").alias("term"), F.col("floor").alias("p"), F.coalesce("width", F.lit(0)).alias("width"))
    held = postings.join(dealt, "lang").select("lang", place["chunk"].alias("chunk"), place["block"].alias("block"), "blocks", "source", "term", "p", F.lit(0).cast("long").alias("width"))
    sent = held.unionByName(floors).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    sent = sent.select("lang", "chunk", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "source", "term", "p", "width")

    def sums(pdf):
        import numpy as np
        import pandas as pd

        own = pdf[pdf["term"].isna()]
        names, lows, blocks = own["source"].to_numpy(), own["p"].to_numpy(np.int64), own["block"].to_numpy()
        order = np.lexsort((names.astype(str), blocks))
        names, lows, blocks = names[order], lows[order], blocks[order]
        of = {s: k for k, s in enumerate(names)}
        held = pdf[pdf["term"].notna()]
        columns, terms = pd.factorize(held["term"])
        p = np.repeat(lows[:, None], len(terms), 1)
        p[held["source"].map(of).to_numpy(np.int64), columns] = held["p"].to_numpy(np.int64)
        rest, same, i = int(own["width"].iat[0]) - len(terms), pdf["i"].iat[0] == pdf["j"].iat[0], int(pdf["i"].iat[0])
        out = []
        for k in range(len(names)) if same else np.flatnonzero(blocks == i):
            to = np.arange(k + 1, len(names)) if same else np.flatnonzero(blocks != i)
            f = np.abs(p[to] - p[k]).sum(1) + rest * np.abs(lows[to] - lows[k])
            out += [(min(names[k], names[t]), max(names[k], names[t]), int(x)) for t, x in zip(to, f)]
        made = pd.DataFrame(out, columns=["a", "b", "value"]).astype({"value": "int64"})
        made.insert(0, "lang", pdf["lang"].iat[0])
        return made

    parts = sent.groupBy("lang", "chunk", "i", "j").applyInPandas(sums, "lang string, a string, b string, value long")
    return parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def source_divergence(docs: DataFrame, path: str) -> DataFrame:
    """lang, source, part (pair or term), item, value, rank for docs (text, lang, source)."""
    docs = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])
    kept = materialize(document_counts(docs).where(F.col("n") >= MIN_DOCS).select("lang", "term"), f"{path}/kept")
    size = kept.groupBy("lang").agg(F.count("*").alias("v"), F.ceil(F.sum(F.length("term") + 2) / DECK_CHARS).alias("decks"))
    size = materialize(running_total(size, ["lang"], F.col("decks"), "first"), f"{path}/size")
    numbers = kept.join(size, "lang").select("term", (F.col("first") + F.pmod(F.xxhash64("term"), F.col("decks"))).alias("deck"))
    numbers.repartition("deck").write.partitionBy("deck").parquet(f"{path}/decks")
    found = materialize(occurrences(docs.join(size, "lang"), f"{path}/decks"), f"{path}/found")

    langs = materialize(found.groupBy("lang").agg(F.sum("n").alias("total")).join(size.select("lang", "v"), "lang"), f"{path}/langs")
    own = found.groupBy("lang", "source").agg(F.sum("n").alias("n_source"))
    occurring = docs.groupBy("lang", "source").agg(F.count("*").alias("rows")).drop("rows")
    groups = occurring.join(own, ["lang", "source"], "left").join(size.select("lang", "v"), "lang", "left")
    groups = groups.select("lang", "source", F.coalesce("n_source", F.lit(0)).alias("n_source"), F.coalesce("v", F.lit(0)).alias("v"))
    floor = F.when(F.col("v") > 0, probability(F.lit(0).cast("long"), F.col("n_source"), F.col("v"))).otherwise(F.lit(0).cast("long"))
    groups = materialize(groups.withColumn("floor", floor), f"{path}/groups")
    postings = found.join(groups, ["lang", "source"]).select("lang", "source", "term", "n", probability(F.col("n"), F.col("n_source"), F.col("v")).alias("p"))
    postings = materialize(postings, f"{path}/postings")

    counted = groups.groupBy("lang").agg(F.count("*").alias("sources"), F.max("v").alias("v"))
    pairs = materialize(_pair_sums(postings.drop("n"), groups, counted, kept, path), f"{path}/pairs")
    pairs = pairs.select("lang", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("x"), "value").select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value")

    whole = postings.groupBy("lang", "term").agg(F.sum("n").alias("n")).join(langs, "lang")
    whole = whole.select("lang", "term", probability(F.col("n"), F.col("total"), F.col("v")).alias("q"))
    more = postings.join(whole, ["lang", "term"]).where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))

    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = [x.withColumn("rank", F.row_number().over(order)) for x in (pairs, more)]
    return ranked[0].unionByName(ranked[1].where(F.col("rank") <= TOP))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: the sources of every language of all documents."""
    return source_divergence(table(spark, sf_dir, "documents"), scratch(spark, "op13"))


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents
), t AS (SELECT i, lang, source, unnest(terms) AS term FROM d
), k AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT i) >= 30
), v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang
), g AS (SELECT DISTINCT d.lang, source, coalesce(v, 0) AS v FROM d LEFT JOIN v USING (lang)
), c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY ALL
), n AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL
), p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + CAST(CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 5) // (coalesce(n.total, 0) + 5 * v) AS BIGINT) AS p
  FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term LEFT JOIN n ON n.lang = g.lang AND n.source = g.source
), q AS (
  SELECT lang, term, 1 + CAST(CAST(1000000000 AS HUGEINT) * (n + 5) // (sum(n) OVER (PARTITION BY lang) + 5 * count(*) OVER (PARTITION BY lang)) AS BIGINT) AS q
  FROM (SELECT lang, term, sum(n) AS n FROM p GROUP BY ALL)
), x AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT y.lang, y.source AS ys, z.source AS zs, sum(abs(y.p - z.p)) AS f FROM p y JOIN p z USING (lang, term) GROUP BY ALL) s ON s.lang = a.lang AND ys = a.source AND zs = b.source
  UNION ALL
  SELECT lang, source, 'term', term, p - q FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item COLLATE "C") AS rank FROM x) WHERE part = 'pair' OR rank <= 50
"""
