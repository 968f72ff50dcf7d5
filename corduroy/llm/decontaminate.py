"""Benchmark decontamination by template windows, with DataFrame functions only (operator 1).

Texts become templates: words in lower case without punctuation, in which numbers (in digits or words), names (capitalised words, at
the start of a sentence as well; a run of up to four is one name) and units after a number are typed placeholders that still carry their
values for later. Windows are WINDOW consecutive words. Two readings count. As a template: windows of template words of which
MIN_FIXED at least are no placeholders; within an alignment (the difference of places) each value of the item stands for one value in
the document, the one that most windows bear out, and no other item value stands for that one; windows that say otherwise are
dropped. As a copy: windows of the words as they are, whatever their case. A document holds an item if at least ``coverage`` of the
item's windows are matched in one reading, or RUN words of it in a row. ``n_windows``, ``n_matched`` and ``coverage`` are those of the
template reading where it suffices; ``kind`` tells copies from re-parameterised ones, in
which half of the values at least are others.

All windows of documents are looked up, but only for the item windows that few items share: the rarest of each item, as many as every
document that reaches the coverage must meet one of, and the rarest of each stretch that every run of RUN words covers. Only for the
pairs so found the other windows are compared, with their texts; a window that is common to many items makes no pair by itself.

Items of fewer than WINDOW words are matched as one window of their own length. Nulls and ties: null ids or texts and texts without
words take no part; repeated rows with one doc_id count as one document with all their windows, repeated items with one item_id
likewise; empty tables give no rows; other columns are not read. Texts may be of any length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, scratch, table

WINDOW, MIN_FIXED, COVERAGE = 6, 3, 0.5
#: Words in a row that tell a copied part of a longer item; the usual length in decontamination by plain word sequences.
RUN = 13
#: Names of units that follow a number.
UNITS = (
    "mm cm dm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers "
    "mg g kg t lb lbs oz gram grams kilogram kilograms pound pounds ounce ounces ton tons ml cl l liter liters litre litres "
    "gallon gallons s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks month months year "
    "years mph kph hz khz mhz ghz w kw kwh v volt volts watt watts c f k usd eur gbp dollar dollars euro euros cent cents percent"
).split()
#: Words for numbers; "twenty-five" and "two hundred" are one number, of four words at most.
NUMBERS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen "
    "nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion"
).split()


_FIRST = "".join(sorted({w[0] for w in NUMBERS} | {w[0].upper() for w in NUMBERS}))
_NUMBER = "|".join(f"{c}(?:{'|'.join(w[1:] for w in NUMBERS if w[0] == c)})" for c in sorted({w[0] for w in NUMBERS}))


def template(text: Column) -> Column:
    """The text's template words, joined by single spaces; placeholders are U+0001, their type (d, n or u) and the value.

    The words of a value of several words are joined by U+0002.
    """
    # what a character itself must be comes before what must stand beside it, so that most places are passed over at once
    worded = F.regexp_replace(text, f"(?=[{_FIRST}])(?<![\\p{{L}}\\p{{N}}])(?i:{_NUMBER})(?![\\p{{L}}\\p{{N}}])", "\u0001d$0")
    named = F.regexp_replace(worded, "\\p{Lu}(?=\\p{Ll})(?<![\\p{L}\\p{N}]\\p{Lu})", "\u0001n$0")
    numbered = F.regexp_replace(named, "(?=[0-9])(?:(?<![\\p{L}\\p{N}\u0001.,])|(?<=[$€£]))", "\u0001d")
    measured = F.regexp_replace(numbered, f"(?i)(\u0001d[0-9][0-9.,:/]*+)[ \\t\\-]?({'|'.join(sorted(UNITS, key=len, reverse=True))})(?![\\p{{L}}\\p{{N}}])", "$1 \u0001u$2")
    marked = F.when(text.rlike("[0-9]"), measured).otherwise(named)
    word = "([\\p{L}\\p{N}]++)"
    runs = F.regexp_replace(marked, f"(\u0001n){word} \u0001n{word}(?: \u0001n{word})?(?: \u0001n{word})?", "$1$2\u0002$3\u0002$4\u0002$5")
    runs = F.regexp_replace(runs, f"(\u0001d)(\\p{{L}}++)[ \\-]\u0001d(\\p{{L}}++)(?:[ \\-]\u0001d(\\p{{L}}++))?(?:[ \\-]\u0001d(\\p{{L}}++))?", "$1$2\u0002$3\u0002$4\u0002$5")
    return F.trim(F.regexp_replace(F.lower(runs), "(?:[^\\p{L}\\p{N}\u0001\u0002.,:/]|[.,:/](?:(?<![0-9].)|(?![0-9]))|\u0002(?![\\p{L}\\p{N}]))+", " "))


def _words(docs: DataFrame, key: str) -> DataFrame:
    """key, p (words as they are), w (template words with values), c (without values), hp and hc (hashes of each of p and c), m (places of placeholders)."""
    rows = docs.where(F.col(key).isNotNull() & F.col("text").rlike("[\\p{L}\\p{N}]")).select(F.col(key).cast("long").alias(key), template(F.col("text")).alias("t"))
    some = F.col("t").contains("\u0001")
    bare = F.when(some, F.regexp_replace("t", "(\u0001[dnu])[^ ]*", "$1")).otherwise(F.col("t"))
    plain = F.col("t")
    for mark, word in (("\u0001d", ""), ("\u0001n", ""), ("\u0001u", ""), ("\u0002", " ")):
        plain = F.replace(plain, F.lit(mark), F.lit(word))
    words = rows.select(key, F.split(plain, " ").alias("p"), F.split("t", " ").alias("w"), F.split(bare, " ").alias("c"))
    places = "filter(transform(c, (x, i) -> if(startswith(x, '\\u0001'), i, -1)), i -> i >= 0)"
    return words.selectExpr(key, "p", "w", "c", "transform(p, x -> xxhash64(x)) AS hp", "transform(c, x -> xxhash64(x)) AS hc", f"{places} AS m")


def _hashes(docs: DataFrame, sizes: list[int]) -> DataFrame:
    """doc_id, size, hash of all windows of words and of those of template words that hold a placeholder (the others are among the first)."""
    each = []
    for s in sizes:
        places = {"hp": f"if(size(hp) >= {s}, sequence(0, size(hp) - {s}), slice(m, 1, 0))"}
        # windows that hold the placeholder at x, but not the one before it
        low, high = f"greatest(0, x - {s - 1}, if(j > 0, get(m, j - 1) + 1, 0))", f"least(x, size(hc) - {s})"
        places["hc"] = f"flatten(transform(m, (x, j) -> if({low} <= {high}, sequence({low}, {high}), slice(m, 1, 0))))"
        hashes = ", ".join(f"transform({at}, i -> xxhash64(slice({h}, i + 1, {s})))" for h, at in places.items())
        each.append(f"named_struct('size', {s}, 'hashes', concat({hashes}))")
    sets = _words(docs, "doc_id").selectExpr("doc_id", f"inline(array({', '.join(each)}))")
    return sets.select("doc_id", "size", F.explode("hashes").alias("hash"))


def _windows(docs: DataFrame, key: str, sizes: list[int], whole: bool = False) -> DataFrame:
    """key, verbatim (the reading), size, at, hash, window (its text), slots of all windows.

    With whole, of texts of fewer than WINDOW words only the whole text, and no template with fewer than MIN_FIXED words that are no
    placeholders (short texts: all words).
    """
    each = []
    for s in sizes:
        for verbatim, words, hashes in ((True, "p", "hp"), (False, "c", "hc")):
            held = f"size({words}) >= {s}" if not whole or s == WINDOW else f"size({words}) = {s}"
            places = f"sequence(0, size({words}) - {s})"
            if whole and not verbatim:
                places = f"filter({places}, i -> size(filter(slice(c, i + 1, {s}), x -> NOT startswith(x, '\\u0001'))) >= {min(MIN_FIXED, s)})"
            slots = "slice(w, 1, 0)" if verbatim else f"filter(slice(w, i + 1, {s}), x -> x like '\\u0001%')"
            each.append(f"transform(if({held}, {places}, slice(m, 1, 0)), i -> named_struct('verbatim', {str(verbatim).lower()}, 'size', {s}, 'at', i, 'hash', xxhash64(slice({hashes}, i + 1, {s})), 'window', array_join(slice({words}, i + 1, {s}), ' '), 'slots', {slots}))")
    return _words(docs, key).selectExpr(key, f"inline(concat({', '.join(each)}))")


def _seeds(items: DataFrame, coverage: float) -> DataFrame:
    """item_id, size, hash of the item windows that are looked up: of each reading the rarest, so that what suffices meets one of them."""
    shared = items.groupBy("size", "hash").agg(F.count_distinct("item_id").alias("items"))
    reading = Window.partitionBy("item_id", "verbatim")
    rarest = ("items", "at", "hash")
    counted = items.select("item_id", "verbatim", "size", "at", "hash").distinct().join(shared, ["size", "hash"])
    counted = counted.withColumn("n", F.count("*").over(reading)).withColumn("place", F.row_number().over(reading.orderBy(*rarest)))
    stretch = Window.partitionBy("item_id", "verbatim", F.floor(F.col("at") / ((RUN - WINDOW + 2) // 2))).orderBy(*rarest)
    counted = counted.withColumn("first", F.row_number().over(stretch))
    return counted.where((F.col("place") <= F.col("n") - F.ceil(F.col("n") * coverage) + 1) | (F.col("first") == 1)).select("item_id", "size", "hash").distinct()


#: SQL for the most places in a row among ``places``.
_LONGEST = "aggregate(array_sort(places), named_struct('last', -2, 'now', 0, 'most', 0), (s, x) -> named_struct('last', x, 'now', if(x = s.last + 1, s.now + 1, 1), 'most', greatest(s.most, if(x = s.last + 1, s.now + 1, 1))), s -> s.most)"


#: SQL for the value that each item value stands for in an alignment: the one in most windows, then the item's own, then the smallest.
_COUNTED = "transform(array_distinct(flatten(windows.slots)), v -> named_struct('item', v.item, 'doc', v.doc, 'n', size(filter(flatten(windows.slots), x -> x = v))))"
_PICKED = "filter(counted, v -> NOT exists(counted, u -> u.item = v.item AND (u.n > v.n OR (u.n = v.n AND u.doc != v.doc AND (u.doc = u.item OR (v.doc != v.item AND u.doc < v.doc))))))"

#: Of those, the ones whose document value no other item value claims with more windows (then its own value, then the smallest).
_CHOSEN = "filter(picked, v -> NOT exists(picked, u -> u.doc = v.doc AND u.item != v.item AND (u.n > v.n OR (u.n = v.n AND (u.doc = u.item OR (v.doc != v.item AND u.item < v.item))))))"


def contaminated(docs: DataFrame, benchmark: DataFrame, path: str, coverage: float = COVERAGE) -> DataFrame:
    """Pairs of documents (doc_id, text) and items (item_id, text) that they hold.

    doc_id, item_id, n_windows (the item's), n_matched, coverage, kind (copy or reparameterised).
    """
    items = materialize(_windows(benchmark, "item_id", list(range(1, WINDOW + 1)), whole=True).distinct(), f"{path}/windows")
    sizes = sorted({r["size"] for r in items.select("size").distinct().limit(WINDOW + 1).collect()})  # WINDOW at most
    if not sizes:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, n_windows long, n_matched long, coverage double, kind string")
    seeds = materialize(_seeds(items, coverage), f"{path}/seeds")
    hits = materialize(_hashes(docs, sizes).join(seeds.select("size", "hash").distinct(), ["size", "hash"], "left_semi").distinct(), f"{path}/hits")
    found = materialize(hits.join(seeds, ["size", "hash"]).select("doc_id", "item_id").distinct(), f"{path}/found")

    held = docs.where("doc_id IS NOT NULL").withColumn("doc_id", F.col("doc_id").cast("long")).join(found.select("doc_id").distinct(), "doc_id", "left_semi")
    windows = _windows(held, "doc_id", sizes).selectExpr("doc_id", "verbatim", "size", "at AS place", "hash", "window", "slots AS values")
    wanted = found.join(items, "item_id")
    pairs = windows.join(wanted, ["doc_id", "verbatim", "size", "hash", "window"]).selectExpr("doc_id", "item_id", "verbatim", "place - at AS shift", "at", "zip_with(slots, values, (a, b) -> named_struct('item', a, 'doc', b)) AS slots")
    aligned = pairs.groupBy("doc_id", "item_id", "verbatim", "shift").agg(F.collect_set(F.struct("at", "slots")).alias("windows"))
    chosen = aligned.withColumn("counted", F.expr(_COUNTED)).withColumn("picked", F.expr(_PICKED)).withColumn("chosen", F.expr(f"transform({_CHOSEN}, v -> named_struct('item', v.item, 'doc', v.doc))"))
    # chosen goes in by a name of its own, or it would be worked out anew for every slot
    fits = "element_at(transform(array(chosen), k -> filter(windows, x -> forall(x.slots, v -> array_contains(k, v)))), 1) AS kept"
    readings = chosen.selectExpr("doc_id", "item_id", "verbatim", fits)
    placed = readings.selectExpr("doc_id", "item_id", "verbatim", "array_distinct(kept.at) AS places", "array_distinct(flatten(kept.slots)) AS stands").withColumn("changed", F.expr("size(stands) > 0 AND 2 * size(filter(stands, v -> v.item != v.doc)) >= size(stands)"))
    matched = placed.select("doc_id", "item_id", "verbatim", F.explode("places").alias("at"), "changed", F.expr(_LONGEST).alias("run"))
    by_pair = matched.groupBy("doc_id", "item_id", "verbatim").agg(F.countDistinct("at").alias("n_matched"), F.countDistinct(F.when(~F.col("changed"), F.col("at"))).alias("n_same"), F.max("run").alias("run"))
    totals = items.groupBy("item_id", "verbatim").agg(F.countDistinct("at").alias("n_windows"))
    counted = by_pair.join(totals, ["item_id", "verbatim"])
    share = F.col("n_matched") / F.col("n_windows")
    kept = counted.where((share >= coverage) | (F.col("run") >= RUN - WINDOW + 1))
    kind = F.when(2 * F.col("n_same") >= F.col("n_matched"), "copy").otherwise("reparameterised")
    each = kept.select("doc_id", "item_id", "verbatim", F.col("n_windows").cast("long").alias("n_windows"), F.col("n_matched").cast("long").alias("n_matched"), share.alias("coverage"), kind.alias("kind"))
    best = each.groupBy("doc_id", "item_id").agg(F.min_by(F.struct("n_windows", "n_matched", "coverage", "kind"), "verbatim").alias("x"))
    return best.select("doc_id", "item_id", "x.*")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of the table that holds a benchmark item, with the items."""
    return contaminated(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"), scratch(spark, "op1"))
