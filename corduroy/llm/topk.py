"""Exact top-k inner products by norm buckets (operator 6).

Vectors are grouped into chunks of one length bucket each (a bucket spans a factor of GROWTH in length), queries into blocks. The
FIRST longest chunks of each dimension meet all queries first: the k-th best score of a query there is a bound for the rest. Then
chunks that are too short for a block's bounds are not sent to it, and a task goes through the others from long vectors to short
ones and keeps the best k of every query so far; the k-th best score (or the bound) over the product of the query's length and the
bucket's greatest length is the bucket's local cosine threshold. Above 1 the bucket is passed over; where it is high, the query's
FOCUS largest coordinates leave only vectors whose coordinates lie in the feasible ranges; else vectors too short for the threshold
are left out. What remains is verified by whole products, and the tasks' lists are merged per query.

Components become floor(1024 * x), exactly. Products are exact: in doubles where they fit 53 bits, else in Python's integers; a
score beyond 64 bits, which the result's type can't hold, becomes the nearest 64-bit integer.

Nulls and ties: vectors that are null, empty of components, or hold a null or non-finite component (1024 * x included) take no
part, nor do rows without vec_id; equal scores rank the smaller vec_id first; vectors of another dimension than the query's are no
candidates; repeated rows with one vec_id are candidates each, but never for their own id. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import map_rows, materialize, scratch, table

SCALE, GROWTH = 1024, 1.25
CHUNK, BLOCK, FIRST = 2048, 512, 2
#: Local cosine thresholds from which the coordinate test is tried before the products, and the coordinates that it looks at.
COORDINATE_FROM, FOCUS = 0.6, 3


def integer_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, v (array of integers as doubles), dim, norm of the vectors that take part."""
    x = F.transform(F.col("embedding").cast("array<double>"), lambda e: e * SCALE)
    usable = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).where("vec_id IS NOT NULL AND x IS NOT NULL AND size(x) > 0 AND forall(x, e -> e IS NOT NULL AND NOT isnan(e) AND abs(e) < double('Infinity'))")
    v = F.transform("x", lambda e: F.when(F.abs(e) < 2.0**53, F.floor(e).cast("double")).otherwise(e))  # larger doubles are whole
    return usable.select("vec_id", v.alias("v")).select("vec_id", "v", F.size("v").alias("dim"), F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, e: a + e * e)).alias("norm"))


def _pack(rows: DataFrame, keys: list[str], most: int, fields: list[str]) -> DataFrame:
    """keys, ids, norms, flat (all components in a row) and bounds, if there: lists of about ``most`` vectors within each group of keys."""
    count = rows.groupBy(*keys).agg(F.ceil(F.count("*") / most).alias("lists"))
    dealt = rows.join(F.broadcast(count), keys)  # a row for each dimension and length bucket
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("vec_id", "v"), F.col("lists")))
    lists = dealt.groupBy(*keys, "part").agg(F.collect_list(F.struct(*fields)).alias("r"))
    more = [F.col("r.bound").alias("bounds")] if "bound" in fields else []
    return lists.select(*keys, F.col("r.vec_id").alias("ids"), F.col("r.norm").alias("norms"), F.flatten("r.v").alias("flat"), *more)


def top_k(candidates: DataFrame, queries: DataFrame, k: int, path: str) -> DataFrame:
    """The k greatest integer inner products of each query with candidates of other ids: query_id, rank, vec_id, score.

    Both tables hold vec_id and embedding. Chunks of candidates are dealt once into groups of a few, and a block of queries is sent
    to the groups' chunks that can reach its bounds; lists hold about CHUNK or BLOCK vectors whatever the tables' size. A query is
    named by its vec_id: rows with one vec_id share one list of k, in which a candidate can stand once for each of them.
    """
    fields = ["vec_id", "norm", "v"]
    bucket = F.when(F.col("norm") > 0, F.floor(F.log("norm") / F.log(F.lit(GROWTH)))).otherwise(F.lit(-(2**31))).cast("int")
    chunks = _pack(integer_vectors(candidates).withColumn("bucket", bucket), ["dim", "bucket"], CHUNK, fields)
    chunks = materialize(chunks.withColumn("chunk", F.expr("uuid()")).withColumn("longest", F.array_max("norms")), f"{path}/chunks")
    asked = materialize(integer_vectors(queries), f"{path}/queries")
    blocks = materialize(_pack(asked.withColumn("bound", F.lit(float("-inf"))), ["dim"], BLOCK, [*fields, "bound"]), f"{path}/blocks")

    order = Window.partitionBy("dim").orderBy(F.desc("longest"), "chunk")  # a small row a chunk
    first = chunks.select("dim", "longest", "chunk").withColumn("place", F.row_number().over(order)).where(F.col("place") <= FIRST)
    few = chunks.join(F.broadcast(first.select("chunk")), "chunk", "left_semi")  # FIRST rows a dimension
    seen = materialize(_best(_met(blocks, few, 1), k), f"{path}/first")
    kth = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    bounds = seen.withColumn("place", F.row_number().over(kth)).where(F.col("place") == k).select(F.col("query_id").alias("vec_id"), (F.col("score") - F.abs("score") * F.when(F.abs("score") < 2**53, 0.0).otherwise(1e-12)).alias("bound"))
    known = asked.join(bounds, "vec_id", "left").withColumn("bound", F.coalesce("bound", F.lit(float("-inf"))))
    blocks = materialize(_pack(known, ["dim"], BLOCK, [*fields, "bound"]), f"{path}/bounded")

    n = chunks.count()
    groups = max(1, min(n, candidates.sparkSession.sparkContext.defaultParallelism), n // 8)
    found = _best(_met(blocks, chunks, groups), k)
    return found.withColumn("rank", F.row_number().over(kth)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _met(blocks: DataFrame, chunks: DataFrame, groups: int) -> DataFrame:
    """Blocks beside the chunks of each group whose longest vector can reach one of the block's bounds."""
    dealt = chunks.withColumn("group", F.pmod(F.xxhash64("chunk"), F.lit(groups))).select("dim", "group", "bucket", "longest", F.col("ids").alias("c_ids"), F.col("norms").alias("c_norms"), F.col("flat").alias("c_flat"))
    # a query of length 0 or with a bound of 0 or less may need any vector
    need = F.array_min(F.zip_with("bounds", "norms", lambda b, q: F.when((b > 0) & (q > 0), b / q).otherwise(0.0)))
    sent = blocks.withColumn("need", need * (1 - 1e-9)).withColumn("group", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
    return sent.join(dealt, ["dim", "group"]).where("longest >= need").drop("need", "longest")


def _best(met: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, score: each task's k best of every query, as far as they reach the query's bound."""

    def run(batches):
        import numpy as np
        import pandas as pd

        def products(a, b):
            if np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * a.shape[1] < 2**53:
                return (a @ b.T).astype(np.int64)
            exact = np.array([[int(e) for e in r] for r in a], object) @ np.array([[int(e) for e in r] for r in b], object).T
            return np.clip(exact, -(2**63), 2**63 - 1).astype(np.int64)

        def keep(s, i, ids, scores):
            fit = (ids != s["ids"][i]) & (scores >= s["bound"][i])
            if not fit.all():
                ids, scores = ids[fit], scores[fit]
            if len(scores) > 4 * k:
                bound = np.partition(scores, len(scores) - k)[len(scores) - k]
                ids, scores = ids[scores >= bound], scores[scores >= bound]
            ids, scores = np.concatenate([s["best"][i][0], ids]), np.concatenate([s["best"][i][1], scores])
            order = np.lexsort((ids, ~scores))[:k]  # ~ reverses the order of all 64-bit integers
            s["best"][i] = ids[order], scores[order]

        def meet(s, ids, p, norm):
            """One chunk, its vectors by falling length, against the block of queries s."""
            least = np.array([max(b[1][-1], o) if len(b[1]) == k else o for b, o in zip(s["best"], s["bound"])], float)  # the k-th best so far
            least[np.isneginf(least)] = np.nan
            with np.errstate(divide="ignore", invalid="ignore"):
                local = least / (s["norm"] * norm[0])  # NaN where all is still open
            high = (local >= COORDINATE_FROM) & (s["norm"] > 0) & (norm[0] > 0)
            for i in np.flatnonzero(high & (local <= 1 + 1e-9)):
                can = np.arange(len(p))
                for f in np.argsort(-np.abs(s["q"][i]), kind="stable")[:FOCUS]:
                    c = s["q"][i][f] / s["norm"][i]
                    u = np.divide(p[can, f], norm[can], out=np.zeros(len(can)), where=norm[can] > 0)
                    # the greatest cosine that a vector with this coordinate can have with the query
                    can = can[u * c + np.sqrt(np.maximum(0, 1 - u * u) * max(0.0, 1 - c * c)) >= local[i] - 1e-9]
                if len(can):
                    keep(s, i, ids[can], products(s["q"][i : i + 1], p[can])[0])
            whole = np.flatnonzero(~high)
            if not len(whole):
                return
            n = len(p)
            if not np.isnan(least[whole]).any() and (s["norm"][whole] > 0).all():  # shorter vectors than this reach no query's k-th best
                need = float((least[whole] / s["norm"][whole]).min())
                n = int(np.searchsorted(-norm, -need * (1 - 1e-9), "right")) if need > 0 else n
            if n:
                got = products(s["q"][whole], p[:n])
                for j, i in enumerate(whole):
                    keep(s, i, ids[:n], got[j])

        def emit(s):
            rows = [(int(q), int(v), int(x)) for q, (ids, scores) in zip(s["ids"], s["best"]) for v, x in zip(ids, scores)]
            return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"])

        s: dict = {}
        for pdf in batches:
            for row in pdf.sort_values("bucket", ascending=False, kind="stable").itertuples(index=False):
                dim = int(row.dim)
                if not s or s["dim"] != dim or not np.array_equal(s["ids"], row.ids):
                    if s:
                        yield emit(s)
                    q = np.asarray(row.flat).reshape(-1, dim)
                    s = {"dim": dim, "ids": np.asarray(row.ids), "q": q, "norm": np.asarray(row.norms), "bound": np.asarray(row.bounds), "best": [(np.empty(0, np.int64), np.empty(0, np.int64))] * len(q)}
                ids, norm, p = np.asarray(row.c_ids), np.asarray(row.c_norms), np.asarray(row.c_flat).reshape(-1, dim)
                order = np.lexsort((ids, -norm))
                meet(s, ids[order], p[order], norm[order])
        if s:
            yield emit(s)

    return map_rows(met, run, "query_id long, vec_id long, score long")


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: the ten best of every hundredth vector."""
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where("vec_id % 100 = 0"), 10, scratch(spark, "op6"))


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10
"""
