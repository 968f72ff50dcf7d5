"""Token ids as flat binary shards (operator 9).

Layout of a shard: ``.bin`` holds unsigned little-endian integers (16 bits when the vocabulary fits, else 32), ``.off``
holds n_docs + 1 unsigned 64-bit offsets counted in ids from the start of the shard, ``.doc`` the signed 64-bit document ids.
Shards follow each other in ascending doc_id; the manifest table names the files, and a prefix sum over its counts gives each
shard's base. File names carry a random part, and only what Spark committed to the manifest counts: a second attempt of a task
leaves a file that nothing refers to.

Nulls and ties: a null text is empty (only the end id), a null doc_id sorts first and is stored as the smallest 64-bit integer,
rows with equal doc_id are ordered by text. Empty tables give no shard and no rows.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import map_rows, materialize, open_fs, scratch, table

NULL_ID = -(2**63)
#: A worker keeps the ids of chunks in 2 ** SLOT_BITS slots (85 MB once all are used): chunks of up to 24 bytes, up to SLOT_IDS ids each.
SLOT_BITS, SLOT_IDS = 21, 8
#: Characters that are encoded in one go; a longer text is cut between two chunks.
PART_CHARS = 1_000_000
#: White space of the tokenizer's splitting pattern (Unicode White_Space), as a character class.
_SPACE = "\\x09-\\x0d\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"

#: Texts of which every tokenizer with a byte-level splitting pattern gives the ids of their chunks.
PROBES = ("a b  c\td", "It's 12,34 \n\n  end", "é日本\u00a0x\u3000y", " lead and trail ")

_loaded: dict = {}


def _encoder(path: str, special_as_text: bool = False):
    """A function from texts to the bytes of their ids, and the type of an id; strings of special tokens in a text are ordinary text or, without special_as_text, get their own ids.

    The byte-level splitting pattern always cuts between a character that is not white space and one that is, so a text is the
    sequence of its chunks "white space, then other characters". The library encodes a chunk when it is first seen; a slot then
    holds its bytes (compared in full) and ids, until another chunk needs the slot.
    """
    if (path, special_as_text) in _loaded:
        return _loaded[path, special_as_text]
    import os
    import re

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import numpy as np
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = special_as_text
    dtype = np.dtype("<u2" if tokenizer.get_vocab_size(with_added_tokens=True) <= 2**16 else "<u4")
    spaces = [chr(i) for i in range(0x3001) if re.fullmatch(f"[{_SPACE}]", chr(i))]
    ascii_space = np.zeros(256, bool)
    ascii_space[[ord(x) for x in spaces if ord(x) < 128]] = True
    wide = [x.encode() for x in spaces if ord(x) >= 128]
    boundary = re.compile(f"(?<=[^{_SPACE}])(?=[{_SPACE}])")
    space, low = set(spaces), np.array([(1 << 8 * n) - 1 for n in range(8)] + [2**64 - 1] * 17, np.uint64)
    low = np.stack([low, np.roll(low, 8), np.roll(low, 16)])
    low[1, :8] = low[2, :16] = 0
    factors = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93], np.uint64)
    keys, lengths = np.zeros((1 << SLOT_BITS, 3), np.uint64), np.zeros(1 << SLOT_BITS, np.uint8)
    held, counts = np.zeros((1 << SLOT_BITS, SLOT_IDS), dtype), np.zeros(1 << SLOT_BITS, np.uint8)

    def by_library(chunks: list[str]) -> dict:
        """The ids of each chunk; chunks that are cut apart in a row as in any text go to the library together."""
        got = {}
        joined = [x for x in chunks if x[0] in space and x[-1] not in space]
        for i in range(0, len(joined), 2048):
            some = joined[i : i + 2048]
            found = tokenizer.encode("".join(some), add_special_tokens=False)
            cuts = np.searchsorted([e for _, e in found.offsets], np.cumsum([len(x) for x in some]), "right")
            got.update(zip(some, np.split(np.array(found.ids, dtype), cuts[:-1])))
        for x in chunks:
            if x not in got:
                got[x] = np.array(tokenizer.encode(x, add_special_tokens=False).ids, dtype)
        return got

    def encode_part(texts: list[str]) -> list[bytes]:
        raw = [x.encode() for x in texts]
        ends = np.cumsum([len(x) for x in raw])
        text = b"".join(raw)
        if not text:
            return [b""] * len(texts)
        data = np.frombuffer(text + bytes(24), np.uint8)
        is_space = ascii_space[data[:-24]]
        for x in wide:
            at = text.find(x)
            while at >= 0:
                is_space[at : at + len(x)] = True
                at = text.find(x, at + 1)
        first = is_space.copy()
        first[1:] &= ~is_space[:-1]
        first[0] = True
        first[ends[ends < len(text)]] = True
        start = np.flatnonzero(first)
        size = np.diff(start, append=len(text))
        short = size <= 24
        window, n = np.lib.stride_tricks.sliding_window_view(data, 24), np.minimum(size, 24)
        key = window[start].view("<u8") & low[:, n].T
        with np.errstate(over="ignore"):
            h = key[:, 0] * factors[0] + key[:, 1] * factors[1] + key[:, 2] * factors[2] + n.astype(np.uint64)
            slot = (((h ^ (h >> np.uint64(32))) * factors[3]) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        known = short & (lengths[slot] == n) & (keys[slot] == key).all(1)
        ids, count = held[slot], np.where(known, counts[slot], 0).astype(np.int64)
        rest = np.flatnonzero(~known)
        words = [text[i:j].decode() for i, j in zip(start[rest].tolist(), (start[rest] + size[rest]).tolist())]
        new = by_library(list(dict.fromkeys(words)))
        large = []
        for i, x in zip(rest.tolist(), words):
            got = new[x]
            count[i] = len(got)
            if len(got) > SLOT_IDS:
                large.append(i)
                continue
            ids[i, : len(got)] = got
            if short[i]:
                s = slot[i]
                keys[s], lengths[s], counts[s], held[s, : len(got)] = key[i], n[i], len(got), got
        here = count.copy()
        here[large] = 0
        flat = ids[np.arange(SLOT_IDS) < here[:, None]]
        if large:
            place = np.repeat(here < count, count)
            out = np.empty(len(place), dtype)
            out[~place] = flat
            out[place] = np.concatenate([new[words[k]] for k in np.searchsorted(rest, large)])
            flat = out
        total = np.append(0, np.cumsum(count))
        upto = total[np.searchsorted(start, ends)].tolist()
        return [flat[i:j].tobytes() for i, j in zip([0, *upto], upto)]

    def encode(texts: list[str]) -> list[bytes]:
        done: list[bytes] = []
        part: list[str] = []
        chars = 0
        for x in texts:
            if len(x) > PART_CHARS:
                done += encode_part(part)
                part, chars, at, pieces = [], 0, 0, []
                while at < len(x):
                    cut = boundary.search(x, at + PART_CHARS)
                    end = cut.start() if cut else len(x)
                    pieces += encode_part([x[at:end]])
                    at = end
                done.append(b"".join(pieces))
                continue
            if chars + len(x) > PART_CHARS:
                done += encode_part(part)
                part, chars = [], 0
            part.append(x)
            chars += len(x)
        return done + encode_part(part)

    for probe in PROBES:
        if encode([probe])[0] != np.array(tokenizer.encode(probe, add_special_tokens=False).ids, dtype).tobytes():
            raise ValueError("the tokenizer does not always cut a text before white space that follows other characters")
    _loaded[path, special_as_text] = encode, dtype
    return _loaded[path, special_as_text]


def write_token_shards(docs: DataFrame, out_dir: str, tokenizer_path: str, end_id: int = 0, special_as_text: bool = False) -> DataFrame:
    """Encode documents (doc_id, text) into shards below out_dir; the manifest (shard, file, width, n_docs, n_tokens, base).

    The texts are dealt once, by ranges of doc_id, so shards hold consecutive documents.
    """

    def write(batches):
        import os
        import uuid

        import numpy as np
        import pandas as pd
        from pyspark import TaskContext

        encode, dtype = _encoder(tokenizer_path, special_as_text)
        end = np.array([end_id], dtype).tobytes()
        shard, name, files, count = TaskContext.get().partitionId(), "", None, 0
        offsets = [np.zeros(1, "<u8")]
        n_docs = 0
        for pdf in batches:
            for at in range(0, len(pdf), 256):
                some = pdf.iloc[at : at + 256]
                if files is None:
                    fs, root = open_fs(out_dir)
                    fs.create_dir(root, recursive=True)
                    name = f"shard-{shard:06d}-{uuid.uuid4().hex[:12]}"
                    files = {k: fs.open_output_stream(os.path.join(root, f"{name}.{k}")) for k in ("bin", "off", "doc")}
                encoded = [x + end for x in encode(list(some["text"]))]
                files["bin"].write(b"".join(encoded))
                files["doc"].write(some["doc_id"].to_numpy("<i8").tobytes())
                ends = count + np.cumsum([len(x) // dtype.itemsize for x in encoded], dtype="<u8")
                if not n_docs:
                    files["off"].write(offsets[0].tobytes())
                files["off"].write(ends.astype("<u8").tobytes())
                count, n_docs = int(ends[-1]), n_docs + len(some)
        if files:
            for f in files.values():
                f.close()
            yield pd.DataFrame({"shard": [shard], "file": [f"{out_dir}/{name}"], "width": [dtype.itemsize], "n_docs": [n_docs], "n_tokens": [count]})

    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    dealt = rows.repartitionByRange(F.col("doc_id")).sortWithinPartitions("doc_id", "text")
    manifest = materialize(map_rows(dealt, write, "shard long, file string, width int, n_docs long, n_tokens long"), f"{out_dir}/manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row a shard
    return manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_token_shards(manifest: DataFrame) -> DataFrame:
    """A row per document from memory-mapped shards: doc_id, start (its first id's place in the corpus), n_tokens, ids_crc32."""

    def read(batches):
        import numpy as np
        import pandas as pd

        for pdf in batches:
            for row in pdf.itertuples():
                fs, path = open_fs(row.file)
                local = fs.type_name == "local"

                def held(kind, dtype):
                    """A whole file of the shard: mapped, or read where the file system can't map it."""
                    return np.memmap(f"{path}.{kind}", dtype, "r") if local else np.frombuffer(fs.open_input_file(f"{path}.{kind}").read(), dtype)

                offsets, names = held("off", "<u8").astype("int64"), held("doc", "<i8")
                source = held("bin", f"<u{row.width}") if local else fs.open_input_file(f"{path}.bin")
                for at in range(0, row.n_docs, 4096):
                    span = range(at, min(at + 4096, row.n_docs))
                    first, last = int(offsets[span.start]), int(offsets[span.stop])
                    # off a local file system, one range of the ids at a time
                    ids = source[first:last] if local else np.frombuffer(source.read_at((last - first) * row.width, first * row.width), f"<u{row.width}")
                    yield pd.DataFrame({
                        "doc_id": pd.array([None if names[i] == NULL_ID else int(names[i]) for i in span], "Int64"),
                        "start": [row.base + int(offsets[i]) for i in span],
                        "n_tokens": [int(offsets[i + 1] - offsets[i]) for i in span],
                        "ids_crc32": [zlib.crc32(ids[offsets[i] - first : offsets[i + 1] - first].astype("<u4").tobytes()) for i in span],
                    })

    n = max(1, manifest.count())
    return map_rows(manifest.repartition(min(n, 100_000)), read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op9_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: shards of the whole documents table, written and read back; ids as Tokenizer.encode(text, add_special_tokens=False) gives them."""
    import public_tokenizers

    return read_token_shards(write_token_shards(table(spark, sf_dir, "documents"), scratch(spark, "op9"), public_tokenizers.path("byte_bpe_50k.json"), special_as_text=False))
