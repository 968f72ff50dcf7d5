"""Near-duplicate groups by MinHash bands, odd sketches and full sets (operator 5).

1. A document's set of word shingles gives MinHash samples: ROWS of them make a band key. One more sample for each of BINS parts of
   the hash range (the least hash in it) is folded into an odd sketch, a bitmap in which each sample flips one bit: the ones in two
   sketches' XOR tell how many samples differ, most precisely where few do.
2. Documents with equal sets are one class; its smallest doc_id stands for it. Classes that share a band key are candidates.
3. In every bucket the members are compared with one hub, the member whose own buckets are the fullest: a bitmap test first, then
   the full sets. Links give components. Buckets whose members are still in several components have HUBS further hubs each, which
   are compared with the members of other components.
4. Larger buckets that still hold several components are compared fully across them, in blocks: first the bitmaps, which leave the
   members that may have a link, then the full sets of those. A task joins what it links at once and returns only links between
   two of its components, so the links returned grow with the members, not with the pairs.

Two documents at the threshold share none of the BANDS band keys with probability under 1e-7; their bitmaps fail the test
(SIGMAS standard deviations, see most_ones) more rarely still. A pair inside one component is never expanded.

Nulls and ties: documents without text or words have an empty set and no links; a null doc_id is in no group (component_id null,
kept); rows with one doc_id are judged by their own texts. Empty tables give no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import frame, map_rows, materialize, partition_end, scratch, table
from .components import components

BANDS, ROWS, BINS, BITS = 32, 4, 1024, 2048
#: Further hubs of an unsettled bucket; members, and shingles, of a block.
HUBS, BLOCK, BLOCK_SHINGLES = 4, 256, 1_000_000
#: Standard deviations by which a pair's bitmaps may exceed the ones expected at the threshold.
SIGMAS = 5.5
_state: dict = {}


def shingle_set(text: str | None, size: int):
    """The sorted hashes of a text's distinct shingles; with fewer words, of the whole sequence."""
    import numpy as np

    from .hashing import mix, window_hashes, word_hashes

    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    hashes = word_hashes(words)
    if len(words) < size:
        return mix(window_hashes(hashes, len(words)), len(words))
    return np.unique(window_hashes(hashes, size))


def _samples(values):
    import numpy as np

    if not _state:
        rng = np.random.default_rng(11)
        _state["a"] = rng.integers(0, 2**63, (BANDS * ROWS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        _state["b"] = rng.integers(0, 2**63, (BANDS * ROWS, 1), dtype=np.uint64)
    least = None
    with np.errstate(over="ignore"):
        for at in range(0, len(values), 4096):
            part = (values[None, at : at + 4096] * _state["a"] + _state["b"]).min(1)
            least = part if least is None else np.minimum(least, part)
    return least


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n (set size), d1, d2 (digests of the set), bands (array<long>), bins (samples in the sketch), sketch (array<long>)."""

    def run(batches):
        import numpy as np

        from .hashing import mix, signed

        band = np.arange(BANDS, dtype=np.uint64)
        for pdf in batches:
            out = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"]):
                s = shingle_set(text, size)
                if not len(s):
                    out.append((doc_id, 0, 0, 0, None, 0, None))
                    continue
                with np.errstate(over="ignore"):
                    d1, d2 = mix(s, 101).sum(dtype=np.uint64), mix(s, 202).sum(dtype=np.uint64)
                    m = _samples(s)
                    key = band
                    for r in range(ROWS):
                        key = mix(key * np.uint64(31) + m[r::ROWS], r + 1)
                bins, odd = odd_sketch(s)
                out.append((doc_id, len(s), int(d1.view(np.int64)), int(d2.view(np.int64)), signed(key), bins, odd))
            yield frame(out, ["doc_id", "n", "d1", "d2", "bands", "bins", "sketch"])

    return map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, n long, d1 long, d2 long, bands array<long>, bins int, sketch array<long>")


def odd_sketch(values):
    """(number of samples, bitmap) of a set of 64-bit hashes: the least hash of each of BINS parts of their range flips a bit."""
    import numpy as np

    from .hashing import mix

    h = np.sort(mix(values, 303))
    part = h >> np.uint64(64 - (BINS - 1).bit_length())
    least = h[np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))]
    bit = (mix(least, 5) % np.uint64(BITS)).astype(int)
    return len(least), np.packbits((np.bincount(bit, minlength=BITS) & 1).astype(np.uint8)).view(np.int64)


def most_ones(na, nb, ba, bb, percent: int, root):
    """The most ones that two sketches' XOR may have for the sets to reach the similarity; for numbers, arrays and columns.

    na, nb are the sets' sizes, ba, bb the numbers of samples. At the threshold the union has u elements; the parts that it fills
    follow from those that either set fills, and the least elements of filled parts are a random choice of the union's elements, so
    the samples in common are hypergeometric. The samples that differ flip bits at random.
    """
    t, empty, once, twice = percent / 100, math.log1p(-1 / BINS), math.log1p(-2 / BITS), math.log1p(-4 / BITS)
    u = (na + nb) / (1 + t)
    filled = BINS - ((BINS - ba) * math.e ** ((u - na) * empty) + (BINS - bb) * math.e ** ((u - nb) * empty)) / 2
    spread = (2 * u - na - nb) / 2 * (ba + bb) / (2 * BINS) * (1 - (ba + bb) / (2 * BINS))
    vary = filled * t * (1 - t) * (1 - filled / u) + t * t * spread
    differ = ba + bb - 2 * t * filled
    p, q = math.e ** (differ * once), math.e ** (differ * twice)
    flips = BITS / 4 * (1 + (BITS - 1) * q - BITS * p * p)
    vary = flips + 4 * p * p * vary
    return BITS / 2 * (1 - p) + SIGMAS * root(vary + 1e-6) + 2


def _linked(pairs: DataFrame, facts: DataFrame, sets: DataFrame, percent: int, path: str) -> DataFrame:
    """The pairs (a, b) that pass the bitmap test and whose full sets have 100 * intersection >= percent * union."""
    both = pairs.join(facts.toDF("a", "na", "ba", "sa"), "a").join(facts.toDF("b", "nb", "bb", "sb"), "b")
    ones = F.aggregate(F.zip_with("sa", "sb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)
    most = _most_ones_column(percent)
    passed = both.where((100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")) & (ones <= most)).select("a", "b")
    passed = materialize(passed, f"{path}/passed")
    held = passed.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")
    common = F.size(F.array_intersect("x", "y"))
    return materialize(held.where(100 * common >= percent * (F.size("x") + F.size("y") - common)).select("a", "b"), f"{path}/links")


def _most_ones_column(percent: int):
    return most_ones(*(F.col(c) for c in ("na", "nb", "ba", "bb")), percent, F.sqrt)


def _open(members: DataFrame, found: DataFrame, done: int, path: str) -> DataFrame:
    """key, m, rep, component of the buckets of more than ``done`` members that hold several components."""
    some = members.where(F.col("m") > done).select("key", "m", "rep")
    placed = some.join(found.select(F.col("node").alias("rep"), "component"), "rep", "left").select("key", "m", "rep", F.coalesce("component", "rep").alias("component"))
    placed = materialize(placed, f"{path}/placed")
    several = materialize(placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key"), f"{path}/several")
    return materialize(placed.join(several, "key"), f"{path}/open")


def near_groups(docs: DataFrame, path: str, size: int = 5, percent: int = 80) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_shingles, component_id (smallest doc_id reachable by links), kept.

    Links join documents whose sets of ``size``-word shingles have 100 * intersection >= percent * union.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sig = materialize(signatures(docs, size), f"{path}/signatures")
    classes = materialize(sig.where("n > 0 AND doc_id IS NOT NULL").groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("rep")), f"{path}/classes")
    same = ["doc_id", "n", "d1", "d2"]
    reps = sig.join(classes.select(F.col("rep").alias("doc_id"), "n", "d1", "d2"), same, "left_semi").dropDuplicates(same)
    reps = materialize(reps.select(F.col("doc_id").alias("rep"), "n", "d1", "d2", "bins", "bands", "sketch"), f"{path}/reps")
    facts = reps.select("rep", "n", "bins", "sketch")

    band = reps.select("rep", F.explode("bands").alias("key"))
    shared = materialize(band.groupBy("key").agg(F.count("*").alias("m")).where("m > 1"), f"{path}/shared")
    members = materialize(band.join(shared, "key"), f"{path}/members")
    central = materialize(members.groupBy("rep").agg(F.sum("m").alias("c")), f"{path}/central")
    sets = materialize(_own_sets(docs, reps, central, size), f"{path}/sets")

    hubs = materialize(members.join(central, "rep").groupBy("key").agg((-F.max(F.struct("c", (-F.col("rep")).alias("r")))["r"]).alias("hub")), f"{path}/hubs")
    first = members.join(hubs, "key").where("rep <> hub").select(F.col("rep").alias("a"), F.col("hub").alias("b")).distinct()
    links = _linked(first, facts, sets, percent, f"{path}/first")
    found = materialize(components(links, f"{path}/first"), f"{path}/first/found")

    left = _open(members, found, 2, f"{path}/second")
    order = Window.partitionBy("key").orderBy(F.xxhash64("rep", "key"), "rep")
    few = left.select("key", "rep", "component", F.row_number().over(order).alias("place")).where(F.col("place") <= HUBS)
    hubs = materialize(few.select("key", F.col("rep").alias("hub"), F.col("component").alias("of")), f"{path}/second/hubs")
    met = left.join(hubs, "key").where("component <> of")
    second = met.select(F.greatest("rep", "hub").alias("a"), F.least("rep", "hub").alias("b")).distinct()
    links = _linked(second, facts, sets, percent, f"{path}/second")
    found = _merged(found, links, f"{path}/second")

    left = _open(members, found, HUBS + 1, f"{path}/third")
    links = materialize(_across(left, facts, sets, percent, f"{path}/third"), f"{path}/third/links")
    found = _merged(found, links, f"{path}/third")

    named = classes.join(found.select(F.col("node").alias("rep"), "component"), "rep", "left").select("n", "d1", "d2", F.coalesce("component", "rep").alias("component_id"))
    named = materialize(named, f"{path}/named")
    rows = sig.select("doc_id", "n", "d1", "d2").join(named, ["n", "d1", "d2"], "left")
    group = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return rows.select("doc_id", F.col("n").alias("n_shingles"), group.alias("component_id"), F.coalesce(F.col("doc_id") == group, F.lit(True)).alias("kept"))


def _own_sets(docs: DataFrame, reps: DataFrame, central: DataFrame, size: int) -> DataFrame:
    """rep and s of the classes that share a bucket; of rows with one doc_id, the set that its digest names."""
    chosen = reps.join(central, "rep", "left_semi").select("rep", "n", "d1", "d2")
    texts = docs.where("text IS NOT NULL").join(chosen.select(F.col("rep").alias("doc_id"), "n", "d1", "d2"), "doc_id")

    def run(batches):
        import numpy as np

        from .hashing import mix, signed

        for pdf in batches:
            kept = []
            for doc_id, text, n, d1, d2 in zip(pdf["doc_id"], pdf["text"], pdf["n"], pdf["d1"], pdf["d2"]):
                s = shingle_set(text, size)
                if len(s) == n and (int(mix(s, 101).sum(dtype=np.uint64).view(np.int64)), int(mix(s, 202).sum(dtype=np.uint64).view(np.int64))) == (d1, d2):
                    kept.append((doc_id, signed(s)))
            yield frame(kept, ["rep", "s"])

    return map_rows(texts, run, "rep long, s array<long>").dropDuplicates(["rep"])


def _merged(found: DataFrame, links: DataFrame, path: str) -> DataFrame:
    """found (node, component) after further links between its nodes or new ones."""
    if links.isEmpty():
        return found
    trees = found.select(F.col("node").alias("a"), F.col("component").alias("b")).where("a <> b")
    return materialize(components(trees.unionByName(links), f"{path}/components"), f"{path}/found")


def _near_pairs(p, q, percent: int):
    """Places (i, j) in frames p and q of pairs of different components that sizes and bitmaps don't rule out."""
    import numpy as np

    def col(x, c):
        return x[c].to_numpy()

    n, m = col(p, "n")[:, None], col(q, "n")[None]
    ok = (col(p, "component")[:, None] != col(q, "component")[None]) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m))
    i, j = np.nonzero(ok)
    x, y = np.stack(p["sketch"].to_list()).view(np.uint64), np.stack(q["sketch"].to_list()).view(np.uint64)
    keep = [np.empty(0, bool)]
    for k in range(0, len(i), 32768):
        a, b = i[k : k + 32768], j[k : k + 32768]
        most = most_ones(col(p, "n")[a], col(q, "n")[b], col(p, "bins")[a], col(q, "bins")[b], percent, np.sqrt)
        keep.append(np.bitwise_count(x[a] ^ y[b]).sum(1) <= most)
    near = np.concatenate(keep)
    return i[near], j[near]


def _sides(pdf):
    p = pdf[pdf["own"] == pdf["i"]]
    return p, pdf[pdf["own"] == pdf["j"]] if pdf["i"].iat[0] != pdf["j"].iat[0] else p


def _across(left: DataFrame, facts: DataFrame, sets: DataFrame, percent: int, path: str) -> DataFrame:
    """Verified links (a, b) that join components within a bucket of ``left`` (key, m, rep, component)."""
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # comparing costs more than its bytes tell
    with_n = left.join(facts.select("rep", "n"), "rep")
    count = with_n.groupBy("key").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_SHINGLES)).alias("blocks"))
    dealt = left.join(materialize(count, f"{path}/count"), "key").withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")))
    dealt = materialize(dealt.join(facts, "rep").select("key", "blocks", "own", "rep", "component", "n", "bins", "sketch"), f"{path}/dealt")
    sent = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    sent = sent.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "rep", "component", "n", "bins", "sketch")

    def may_link(pdf):
        """The rows that have a partner by their bitmaps."""
        import numpy as np

        p, q = _sides(pdf)
        if not len(p) or not len(q):
            return pdf.iloc[:0]
        i, j = _near_pairs(p, q, percent)
        return pdf.loc[np.unique(np.concatenate([p.index[i], q.index[j]]))] if len(i) else pdf.iloc[:0]

    def link(pdf):
        """Of the pairs with full sets alike, those that join two components; pairs inside one by then are passed over."""
        import numpy as np
        import pandas as pd

        p, q = _sides(pdf)
        parent = {c: c for c in pdf["component"].tolist()}

        def root(c):
            while parent[c] != c:
                parent[c] = c = parent[parent[c]]
            return c

        out = []
        if len(p) and len(q):
            x, y = ([np.asarray(s).view(np.uint64) for s in side["s"]] for side in (p, q))
            for i, j in zip(*(k.tolist() for k in _near_pairs(p, q, percent))):
                a, b = root(p["component"].iat[i]), root(q["component"].iat[j])
                if a == b:
                    continue
                both = len(np.intersect1d(x[i], y[j], assume_unique=True))
                if 100 * both >= percent * (len(x[i]) + len(y[j]) - both):
                    parent[a] = b
                    out.append((p["rep"].iat[i], q["rep"].iat[j]))
        partition_end()
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    keys = ["key", "i", "j"]
    likely = materialize(sent.repartition(tasks, *keys).groupBy(*keys).applyInPandas(may_link, sent.schema), f"{path}/likely")
    whole = likely.join(sets, "rep").select(*sent.columns, "s")
    return whole.repartition(tasks, *keys).groupBy(*keys).applyInPandas(link, "a long, b long").distinct()


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: groups of documents whose sets of 4-word shingles are alike by 80 % or more."""
    return near_groups(table(spark, sf_dir, "documents"), scratch(spark, "op5"), size=4, percent=80)
