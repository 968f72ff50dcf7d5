"""Document quality by a byte-level convolutional network in numpy (operator 8).

Bytes have learned vectors; learned filters of WIDTH bytes slide over the whole document in steps of STEP. Their outputs are
max-pooled within overlapping chunks of 2 * BLOCK bytes (each shares half with the next), rectified, and the chunks' mean,
maximum and minimum go into one logistic probability. A document is padded with zero bytes to whole blocks, two at least.

It is trained on the driver from a bounded sample of whole texts: at most TRAIN_DOCS labelled documents, those with the smallest
hashes of doc_id, of which the shorter ones up to TRAIN_BYTES together. Scoring covers every byte of every text.

Nulls and ties: a null text counts as empty and is scored as such; rows with equal doc_id are all scored, and the one with the
smallest hash teaches; labels that are null teach nothing. With no labels, or labels of one kind only, the score is the share of
label 1 (0.5 without labels). Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import bounded_batches, crc32_mod, partition_end, table

BLOCK, WIDTH, STEP, FILTERS, DIMS = 256, 6, 2, 24, 8
#: Bounds of the sample: documents, and bytes of their texts.
TRAIN_DOCS, TRAIN_BYTES, EPOCHS = 1500, 8 << 20, 14
THRESHOLD = 0.3


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS, most_bytes: int = TRAIN_BYTES) -> list[tuple[int, bytes]]:
    """(label, text) of at most ``most`` documents with a label, picked by a hash of the id, most_bytes in all (the shorter ones)."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
    few = known.distinct().orderBy(F.xxhash64(F.lit("quality"), "doc_id"), "quality").limit(most)
    joined = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(few), "doc_id")  # at most ``most`` rows
    one = joined.groupBy("doc_id", "quality").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    size = F.octet_length("text")
    upto = F.sum(size).over(Window.orderBy(size, "doc_id", "quality").rowsBetween(Window.unboundedPreceding, 0))  # at most ``most`` rows
    rows = one.withColumn("upto", upto).where(F.col("upto") <= most_bytes).orderBy("doc_id", "quality").collect()
    return [(r["quality"], r["text"].encode("utf-8", "replace")) for r in rows]


def _padded(texts: list[bytes]):
    """(bytes of all texts, each padded to whole blocks and the last by WIDTH bytes more; blocks of each)."""
    import numpy as np

    blocks = np.array([max(2, -(-len(x) // BLOCK)) for x in texts])
    return np.frombuffer(b"".join(x.ljust(n * BLOCK, b"\0") for x, n in zip(texts, blocks)) + b"\0" * WIDTH, np.uint8), blocks


def _edges(data, blocks):
    """Places whose filters reach beyond their document, and the bytes that they see: zeros there."""
    import numpy as np

    ends = np.cumsum(blocks)
    edge = (ends[:, None] * BLOCK // STEP - np.arange(WIDTH // STEP - 1, 0, -1)).reshape(-1)
    reach = edge[:, None] * STEP + np.arange(WIDTH)
    return edge, np.where(reach < np.repeat(ends * BLOCK, WIDTH // STEP - 1)[:, None], data[reach], 0)


def _filtered(tables, data, blocks, per_slice: int = 1024):
    """Yields (first block, outputs of all filters at all places: block, place, filter) for a slice of blocks after another."""
    n_blocks, each = int(blocks.sum()), BLOCK // STEP
    edge, own = _edges(data, blocks)
    edge_out = sum(tables[j][own[:, j]] for j in range(WIDTH))
    for at in range(0, n_blocks, per_slice):
        n = min(per_slice, n_blocks - at)
        part = data[at * BLOCK : (at + n) * BLOCK + WIDTH]
        acc = tables[0].take(part[: n * BLOCK : STEP], 0)
        for j in range(1, WIDTH):
            acc += tables[j].take(part[j : n * BLOCK + j : STEP], 0)
        here = (edge >= at * each) & (edge < (at + n) * each)
        acc[edge[here] - at * each] = edge_out[here]
        yield at, acc.reshape(n, each, -1)


def _tables(embed, filters):
    """A row of filter outputs for each byte value, for each of the WIDTH places of a filter."""
    import numpy as np

    return [(embed @ filters.reshape(WIDTH, DIMS, FILTERS)[j]).astype(np.float32) for j in range(WIDTH)]


def train(sample: list[tuple[int, bytes]], seed: int = 7) -> dict:
    """The network's weights: tables (a row of filter outputs for each byte value and place), bias, and the logistic layer."""
    import numpy as np

    y = np.array([label for label, _ in sample], np.float32)
    if not len(y) or y.min() == y.max():
        return {"constant": float(y.mean()) if len(y) else 0.5}
    rng = np.random.default_rng(seed)
    p = {"embed": rng.normal(0, 0.5, (256, DIMS)), "filters": rng.normal(0, 0.3, (WIDTH * DIMS, FILTERS)), "bias": np.zeros(FILTERS), "out": rng.normal(0, 0.1, 3 * FILTERS), "base": np.array([np.log(y.mean() / (1 - y.mean()))])}
    p = {k: v.astype(np.float32) for k, v in p.items()}
    m, v, step = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for at in range(0, len(order), 64):
            some = order[at : at + 64]
            g = _gradient(p, [sample[i][1] for i in some], y[some])
            step += 1
            for k in p:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                p[k] = (p[k] - 0.01 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return {"tables": _tables(p["embed"], p["filters"]), "bias": p["bias"], "out": p["out"].astype(float), "base": float(p["base"][0])}


def _gradient(p: dict, texts: list[bytes], y) -> dict:
    """The loss's gradient on a batch of whole texts; only the places with a chunk's greatest outputs bear on it."""
    import numpy as np

    data, blocks = _padded(texts)
    top, place = [], []
    for at, out in _filtered(_tables(p["embed"], p["filters"]), data, blocks, 128):
        best = out.argmax(1)
        top.append(np.take_along_axis(out, best[:, None], 1)[:, 0])
        place.append(best + (at + np.arange(len(out)))[:, None] * (BLOCK // STEP))
    top, place = np.concatenate(top), np.concatenate(place)
    keep = np.ones(len(top) - 1, bool)
    keep[np.cumsum(blocks)[:-1] - 1] = False  # chunks across two documents
    second = top[1:] > top[:-1]
    top, place = np.where(second, top[1:], top[:-1])[keep], np.where(second, place[1:], place[:-1])[keep]
    counts = blocks - 1
    first, owner = np.concatenate([[0], np.cumsum(counts)[:-1]]), np.repeat(np.arange(len(texts)), counts)
    h = np.maximum(top + p["bias"], 0)
    mean = np.add.reduceat(h, first) / counts[:, None]
    peak, least = np.maximum.reduceat(h, first), np.minimum.reduceat(h, first)
    pooled = np.concatenate([mean, peak, least], 1)
    d = (1 / (1 + np.exp(-(pooled @ p["out"] + p["base"]))) - y) / len(y)
    g = {"out": pooled.T @ d + 1e-4 * p["out"], "base": np.array([d.sum()])}
    dh = (d[:, None] * p["out"][:FILTERS] / counts[:, None])[owner] + (d[:, None] * p["out"][FILTERS:-FILTERS])[owner] * (h == peak[owner])
    dh += (d[:, None] * p["out"][-FILTERS:])[owner] * (h == least[owner])
    dh *= h > 0
    g["bias"] = dh.sum(0)
    edge, own = _edges(data, blocks)
    seen = data[place[:, :, None] * STEP + np.arange(WIDTH)]  # chunk, filter, byte
    found = np.minimum(np.searchsorted(edge, place), len(edge) - 1)
    seen = np.where((edge[found] == place)[:, :, None], own[found], seen)
    g["filters"], g["embed"] = np.zeros_like(p["filters"]), np.zeros_like(p["embed"])
    weights = p["filters"].reshape(WIDTH, DIMS, FILTERS)
    for j in range(WIDTH):
        byte = seen[:, :, j]
        hits = np.zeros((256, FILTERS), np.float32)  # the gradient of each byte value at place j, for each filter
        np.add.at(hits, (byte, np.arange(FILTERS)[None]), dh)
        g["filters"].reshape(WIDTH, DIMS, FILTERS)[j] = p["embed"].T @ hits
        g["embed"] += hits @ weights[j].T
    return g


def score_texts(model: dict, texts: list[bytes]):
    """Probabilities of whole texts, a few hundred at a time."""
    import numpy as np

    if "constant" in model:
        return np.full(len(texts), model["constant"])
    data, blocks = _padded(texts)
    ends = np.cumsum(blocks)
    tops = [out.max(1) for _, out in _filtered(model["tables"], data, blocks)]
    block = np.concatenate(tops)
    chunk = np.maximum(block[:-1], block[1:])  # overlapping chunks; those across two documents are left out below
    keep = np.ones(len(chunk), bool)
    keep[ends[:-1] - 1] = False
    h = np.maximum(chunk[keep] + model["bias"], 0).astype(float)
    counts = blocks - 1
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])
    z = np.concatenate([np.add.reduceat(h, first) / counts[:, None], np.maximum.reduceat(h, first), np.minimum.reduceat(h, first)], 1) @ model["out"] + model["base"]
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def score_quality(docs: DataFrame, model: dict, keep: list[str] | None = None, name: str = "score") -> DataFrame:
    """The columns named in keep (doc_id by default) as they are, with the probability of label 1 of each text as ``name``."""
    keep = ["doc_id"] if keep is None else keep
    rows = docs.select(*dict.fromkeys([*keep, "text"]))
    schema = T.StructType([*(f for f in rows.schema if f.name in keep), T.StructField(name, T.DoubleType())])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            data = [b"" if x is None else x.encode("utf-8", "replace") for x in batch.column("text").to_pylist()]
            scores, at = [], 0
            while at < len(data):
                to, size = at, 0
                while to < len(data) and (to == at or size + len(data[to]) < 2_000_000):
                    size += len(data[to])
                    to += 1
                scores.append(score_texts(model, data[at:to]))
                at = to
            arrays = [batch.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array([float(x) for s in scores for x in s], pa.float64())], names=[*keep, name])
        partition_end()

    bounded_batches(docs.sparkSession)
    return rows.mapInArrow(run, schema)


def quality_model(docs: DataFrame, labels: DataFrame, held_out: bool = True) -> dict:
    """A trained network; with held_out, labels of documents whose crc32(doc_id) mod 5 is 0 are not used."""
    known = labels.where(crc32_mod("doc_id", 5) != 0) if held_out else labels
    return train(labelled_sample(docs, known))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: the quality score of every document."""
    docs = table(spark, sf_dir, "documents").withColumn("doc_id", F.col("doc_id").cast("long"))
    scored = score_quality(docs, quality_model(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (crc32_mod("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
