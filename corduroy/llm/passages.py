"""Repeated passages by a log-structured fingerprint index (operator 4).

A document's fingerprints are hashes of GRAM words, picked by winnowing: of every run of words as long as a window, at least the
least hash is picked, so equal windows in two documents always share a fingerprint. Batches of documents in ascending doc_id go
through the index: a batch becomes a sorted immutable run (fingerprint, smallest and largest doc_id), which is merge-joined with
the runs of earlier batches; more than FAN_IN of them are compacted into one before the next batch. Only windows around fingerprints that
occur in two documents are then compared, by 96-bit hashes of whole windows, with the smallest doc_id of each: that verifies every
fingerprint match exactly where a passage begins and ends. Documents whose words repeat a smaller one's in full are found by a
digest of all words and need no windows.

Nulls and ties: a null text has no words; a null doc_id neither removes nor loses words; rows with one doc_id don't remove each
other's words and are told apart by their words. Empty tables give no rows.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import frame, map_rows, materialize, scratch, table

GRAM, FAN_IN, BATCHES = 12, 1, 3


def _slide(x, width: int, best):
    """best (minimum or maximum) of every ``width`` consecutive values, by doubling."""
    done = 1
    while done * 2 <= width:
        x = best(x[:-done], x[done:])
        done *= 2
    rest = width - done
    return best(x[: len(x) - rest], x[rest:]) if rest else x


def winnowed(hashes, width: int):
    """Which values are the least of some ``width`` consecutive ones."""
    import numpy as np

    least = _slide(hashes, width, np.minimum)
    edge = np.zeros(width - 1, hashes.dtype)
    return _slide(np.concatenate([edge, least, edge]), width, np.maximum) == hashes


def _digests(hashes):
    from .hashing import sequence_digest

    return sequence_digest(hashes, 3), sequence_digest(hashes, 4)


def fingerprints(docs: DataFrame, window: int) -> DataFrame:
    """doc_id, n (words), d1, d2 (digests of all words), sha (of the words joined by spaces), anchors (picked fingerprints)."""

    def run(batches):
        import numpy as np

        from .hashing import signed, window_hashes, word_hashes

        for pdf in batches:
            out = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"]):
                words = (text or "").encode("utf-8", "replace").split()
                hashes = word_hashes(words)
                anchors = np.empty(0, np.int64)
                if len(words) >= window:
                    grams = window_hashes(hashes, GRAM)
                    anchors = signed(np.unique(grams[winnowed(grams, window - GRAM + 1)]))
                out.append((doc_id, len(words), *_digests(hashes), hashlib.sha256(b" ".join(words)).hexdigest(), anchors))
            yield frame(out, ["doc_id", "n", "d1", "d2", "sha", "anchors"])

    return map_rows(docs, run, "doc_id long, n long, d1 long, d2 long, sha string, anchors array<long>")


class FingerprintLog:
    """Sorted immutable runs (fp, lo, hi) below a shared folder; ``add`` returns the fingerprints of a batch that two documents hold.

    A manifest names the runs in force after each batch, so a log opened on the same folder goes on where the last batch ended.
    A batch finds at most ``fan_in`` runs of history: more are merged into one before it, and that run is what it is joined with.
    """

    MANIFEST = "batch long, runs array<string>"

    def __init__(self, spark: SparkSession, path: str, fan_in: int = FAN_IN, new: bool = False):
        self.spark, self.path, self.fan_in, self.n = spark, path, fan_in, 0
        self.runs: list[str] = []
        if not new and (last := self._manifest()):
            self.n, self.runs = last["batch"], list(last["runs"])

    def _manifest(self):
        from pyspark.errors import AnalysisException

        try:
            return self.spark.read.schema(self.MANIFEST).json(f"{self.path}/manifest").orderBy(F.desc("batch")).first()
        except AnalysisException:  # no manifest: an empty log
            return None

    def _read(self, run: str) -> DataFrame:
        return self.spark.read.schema("fp long, lo long, hi long").parquet(f"{self.path}/{run}")

    def _write(self, run: DataFrame, name: str) -> str:
        name = f"{name}-{uuid.uuid4().hex[:8]}"
        materialize(run, f"{self.path}/{name}", sort="fp")
        return name

    def add(self, batch: DataFrame) -> DataFrame:
        """Take in a batch (fp, doc_id); returns fp of those now known from two documents with this batch's part in it."""
        if len(self.runs) > self.fan_in:
            self.compact()
        self.n += 1
        name = self._write(batch.groupBy("fp").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")), f"run-{self.n:06d}")
        run = self._read(name)
        found = run.where("lo < hi").select("fp")
        for older in self.runs:
            both = run.join(self._read(older).toDF("fp", "old_lo", "old_hi"), "fp").where("least(lo, old_lo) < greatest(hi, old_hi)")
            found = found.unionByName(both.select("fp"))
        found = materialize(found.distinct(), f"{self.path}/found-{self.n:06d}-{uuid.uuid4().hex[:8]}")
        self.runs.append(name)
        self.spark.createDataFrame([(self.n, self.runs)], self.MANIFEST).coalesce(1).write.mode("append").json(f"{self.path}/manifest")
        return found

    def compact(self) -> None:
        """Merge all runs into one; the old ones are left to whoever still reads them."""
        merged = self._read(self.runs[0])
        for run in self.runs[1:]:
            merged = merged.unionByName(self._read(run))
        self.runs = [self._write(merged.groupBy("fp").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")), f"merged-{self.n:06d}")]


def _windows(texts: DataFrame, window: int) -> DataFrame:
    """w1, w2 (hashes of a window), doc_id, d1, d2, at: the windows that hold one of the row's fingerprints ``fps``."""

    def run(batches):
        import numpy as np
        import pandas as pd

        from .hashing import mix, signed, window_hashes, word_hashes

        width, names = window - GRAM + 1, ("w1", "w2", "doc_id", "d1", "d2", "at")
        for pdf in batches:
            parts, n = [], 0
            for doc_id, d1, d2, fps, text in zip(pdf["doc_id"], pdf["d1"], pdf["d2"], pdf["fps"], pdf["text"]):
                hashes = word_hashes(text.encode("utf-8", "replace").split())
                if (d1, d2) != _digests(hashes):  # another row with this doc_id
                    continue
                fps = np.sort(np.asarray(fps, np.int64))
                grams = signed(window_hashes(hashes, GRAM))
                held = fps[np.minimum(np.searchsorted(fps, grams), len(fps) - 1)] == grams
                count = np.concatenate([[0], np.cumsum(held)])
                at = np.flatnonzero(count[width:] > count[:-width])
                w1, w2 = window_hashes(hashes, window)[at], window_hashes(mix(hashes, 9), window)[at] >> np.uint64(33)
                parts.append((signed(w1), w2.astype(np.int32), np.full(len(at), doc_id), np.full(len(at), d1), np.full(len(at), d2), at.astype(np.int32)))
                n += len(at)
                if n > 100_000:
                    yield pd.DataFrame({k: np.concatenate(x) for k, x in zip(names, zip(*parts))})
                    parts, n = [], 0
            if parts:
                yield pd.DataFrame({k: np.concatenate(x) for k, x in zip(names, zip(*parts))})

    return map_rows(texts, run, "w1 long, w2 int, doc_id long, d1 long, d2 long, at int")


def remove_repeats(docs: DataFrame, path: str, window: int = 50, batches: int = BATCHES, text: bool = False) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_words, n_removed, kept_sha256, and with ``text`` the kept words joined by spaces.

    Removed are the words of every window of ``window`` words whose sequence also starts in a document with a smaller doc_id.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    facts = materialize(fingerprints(docs, window), f"{path}/facts")
    long_ = facts.where((F.col("n") >= window) & F.col("doc_id").isNotNull())
    twice = materialize(long_.groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("n", "d1", "d2", "lo"), f"{path}/twice")
    copies = materialize(long_.select("doc_id", "n", "d1", "d2").join(twice, ["n", "d1", "d2"]).where("doc_id > lo").select("doc_id", "d1", "d2").distinct(), f"{path}/copies")
    anchors = long_.join(copies, ["doc_id", "d1", "d2"], "left_anti").select("doc_id", "d1", "d2", F.explode("anchors").alias("fp"))

    log = FingerprintLog(docs.sparkSession, f"{path}/index", new=True)
    bounds = [x for x in long_.approxQuantile("doc_id", [k / batches for k in range(1, batches)], 0.01)] if batches > 1 else []
    found = None
    for low, high in zip([None, *bounds], [*bounds, None]):
        part = anchors
        part = part if low is None else part.where(F.col("doc_id") > low)
        part = part if high is None else part.where(F.col("doc_id") <= high)
        new = log.add(part.select("fp", "doc_id"))
        found = new if found is None else found.unionByName(new)
    matched = materialize(found.distinct(), f"{path}/matched")

    held = anchors.join(matched, "fp").groupBy("doc_id", "d1", "d2").agg(F.collect_list("fp").alias("fps"))  # a document's own
    texts = materialize(docs.join(materialize(held, f"{path}/held"), "doc_id"), f"{path}/texts")
    shown = _windows(texts, window)
    repeats = materialize(shown.groupBy("w1", "w2").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("w1", "w2", "lo"), f"{path}/repeats")
    starts = shown.join(repeats, ["w1", "w2"]).where("doc_id > lo").select("doc_id", "d1", "d2", "at")
    starts = starts.groupBy("doc_id", "d1", "d2").agg(F.collect_set("at").alias("starts"))

    def cut(rows):
        import numpy as np

        from .hashing import word_hashes

        for pdf in rows:
            out = []
            for row in pdf.itertuples(index=False):
                words = row.text.encode("utf-8", "replace").split()
                if (row.d1, row.d2) != _digests(word_hashes(words)):
                    continue
                edge = np.zeros(len(words) + 1, np.int64)
                at = np.asarray(row.starts)
                np.add.at(edge, at, 1)
                np.add.at(edge, at + window, -1)
                gone = np.cumsum(edge[:-1]) > 0
                kept = b" ".join([w for w, g in zip(words, gone) if not g])
                out.append((row.doc_id, row.d1, row.d2, int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept.decode() if text else None))
            yield frame(out, ["doc_id", "d1", "d2", "cut", "cut_sha", "kept_text"])

    changed = map_rows(texts.select("doc_id", "d1", "d2", "text").join(starts, ["doc_id", "d1", "d2"]), cut, "doc_id long, d1 long, d2 long, cut long, cut_sha string, kept_text string")
    changed = materialize(changed.unionByName(copies.select("doc_id", "d1", "d2", F.lit(None).cast("long").alias("cut"), F.lit(hashlib.sha256(b"").hexdigest()).alias("cut_sha"), F.lit("" if text else None).cast("string").alias("kept_text"))).dropDuplicates(["doc_id", "d1", "d2"]), f"{path}/changed")
    rows = facts.select("doc_id", "n", "d1", "d2", "sha").join(changed, ["doc_id", "d1", "d2"], "left")
    removed = F.when(F.col("cut_sha").isNull(), 0).otherwise(F.coalesce("cut", "n"))
    out = rows.select("doc_id", F.col("n").alias("n_words"), removed.cast("long").alias("n_removed"), F.coalesce("cut_sha", "sha").alias("kept_sha256"), *(["d1", "d2", "kept_text"] if text else []))
    if not text:
        return out
    words = F.array_join(F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != ""), " ")
    whole = fingerprinted(docs).withColumn("words", F.coalesce(words, F.lit(""))).dropDuplicates(["doc_id", "d1", "d2"]).select("doc_id", "d1", "d2", "words")
    return out.join(whole, ["doc_id", "d1", "d2"], "left").select("doc_id", "n_words", "n_removed", "kept_sha256", F.coalesce("kept_text", "words").alias("text"))


def fingerprinted(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with d1 and d2, the digests of all words."""

    def run(batches):
        import pandas as pd

        from .hashing import word_hashes

        for pdf in batches:
            found = [_digests(word_hashes((x or "").encode("utf-8", "replace").split())) for x in pdf["text"]]
            yield pd.concat([pdf.reset_index(drop=True), pd.DataFrame(found, columns=["d1", "d2"])], axis=1)

    return map_rows(docs, run, "doc_id long, text string, d1 long, d2 long")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: passages of 50 words or more that repeat a document with a smaller doc_id, removed from every document."""
    return remove_repeats(table(spark, sf_dir, "documents"), scratch(spark, "op4"))
