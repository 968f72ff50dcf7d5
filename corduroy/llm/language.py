"""Language identification by compression (operator 7).

Each language has a raw-content zstandard dictionary made of a bounded sample of its documents, in lower case as all texts are
here: of the DOCS_PER_LANGUAGE distinct texts with the smallest hashes, the shorter ones that fit into DICTIONARY_BYTES as wholes
(one at least; with over 384 languages, into an equal part of ALL_BYTES). No text is cut. A text is cut into pieces of PIECE_BYTES that cover all of it, every piece is compressed with every dictionary, and the language whose sizes add up to least
wins; equal sums go to the smaller language name. A margin narrower than ``margin`` marks the answer as rejected.

Nulls and ties: a null text or one without a letter is ``und`` with score 0; rows without language or text teach nothing; rows
with equal doc_id are all returned. Without any training row every answer is ``und``. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import crc32_mod, map_rows, table

PIECE_BYTES = 2048
#: Bounds of the sample: whole documents a language, bytes of a language's dictionary, and of all (they sit in every task).
DOCS_PER_LANGUAGE, DICTIONARY_BYTES, ALL_BYTES = 64, 128 << 10, 48 << 20
#: Match finder: short matches count, since the words of a language differ by a few letters.
SEARCH = {"window_log": 18, "hash_log": 17, "chain_log": 16, "search_log": 4, "min_match": 3}
#: How fast the score falls with the relative excess of the other languages' sizes.
SHARPNESS = 40.0


def learn_languages(docs: DataFrame, docs_per_language: int = DOCS_PER_LANGUAGE, dictionary_bytes: int = DICTIONARY_BYTES) -> dict[str, bytes]:
    """Dictionaries by language from docs (text, lang): whole distinct texts, docs_per_language and dictionary_bytes at most each (one text at least)."""
    rows = docs.select("lang", "text").where(F.col("lang").isNotNull() & F.col("text").rlike("\\p{L}")).withColumn("h", F.xxhash64("text"))
    distinct = rows.groupBy("lang", "h").agg(F.min(F.octet_length("text")).alias("size"))
    share = min(dictionary_bytes, ALL_BYTES // max(1, distinct.select("lang").distinct().count()))  # less where there are very many languages
    order = Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(1 << 30)), "h")
    few = distinct.withColumn("n", F.row_number().over(order)).where(F.col("n") <= docs_per_language)
    by_size = Window.partitionBy("lang").orderBy("size", "n").rowsBetween(Window.unboundedPreceding, -1)
    fit = few.withColumn("before", F.coalesce(F.sum("size").over(by_size), F.lit(0))).where(f"before = 0 OR before + size <= {share}")
    held = rows.join(F.broadcast(fit), ["lang", "h"])  # docs_per_language rows a language
    picked = held.groupBy("lang", "n").agg(F.min("text").alias("text")).collect()
    found: dict[str, list[str]] = {}
    for r in sorted(picked, key=lambda r: (r["lang"], r["n"])):
        found.setdefault(r["lang"], []).append(r["text"])
    return {lang: "\n".join(texts).lower().encode("utf-8", "replace") for lang, texts in found.items()}


def identify_languages(docs: DataFrame, dictionaries: dict[str, bytes], margin: float = 0.01) -> DataFrame:
    """Per document of docs (doc_id, text): doc_id, lang_pred, score (0 to 1), margin (relative excess of the second best), rejected."""
    names = sorted(dictionaries)

    def run(batches):
        import numpy as np
        import pandas as pd
        import regex
        import zstandard

        coders = []
        for name in names:
            d = zstandard.ZstdCompressionDict(dictionaries[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            how = zstandard.ZstdCompressionParameters(strategy=zstandard.STRATEGY_LAZY, write_content_size=False, write_checksum=False, write_dict_id=False, **SEARCH)
            d.precompute_compress(compression_params=how)
            coders.append(zstandard.ZstdCompressor(dict_data=d, compression_params=how).compress)
        letter = regex.compile(r"\p{L}").search
        for pdf in batches:
            out = []
            for text in pdf["text"]:
                if not coders or text is None or not letter(text):
                    out.append(("und", 0.0, 0.0, True))
                    continue
                data = text.lower().encode("utf-8", "replace")
                pieces = [data[i : i + PIECE_BYTES] for i in range(0, len(data), PIECE_BYTES)]
                sizes = np.array([sum([len(code(x)) for x in pieces]) for code in coders], float)
                best = int(sizes.argmin())
                excess = sizes / sizes[best] - 1
                gap = float(np.delete(excess, best).min()) if len(sizes) > 1 else 1.0
                out.append((names[best], float(1 / np.exp(-SHARPNESS * excess).sum()), gap, gap < margin))
            frame = pd.DataFrame(out, columns=["lang_pred", "score", "margin", "rejected"])
            frame.insert(0, "doc_id", pdf["doc_id"].to_numpy())
            yield frame

    return map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, lang_pred string, score double, margin double, rejected boolean")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: the language of every document, learnt from documents whose crc32(doc_id) mod 4 is not 2."""
    docs = table(spark, sf_dir, "documents")
    dictionaries = learn_languages(docs.where(crc32_mod("doc_id", 4) != 2))
    found = identify_languages(docs, dictionaries)
    return found.select("doc_id", (crc32_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "margin", "rejected")
