"""WARC archives with an index written first (operator 3).

Each page becomes one gzip member, so that a record can be read alone. Writing a batch appends the members to archive files of at
most FILE_BYTES and emits the index: file, offset, length, url, digest. Of pages with equal payloads of at least
``min_revisit_bytes`` bytes the one with the smallest page_id is the response, the others are revisit records without payload that
name it. Reading sorts the selected index rows by place, joins ranges closer than GAP_BYTES into one read of at most SPAN_BYTES,
and cuts the records out of it.

Archive names carry a random part and only the committed index refers to them, so a second attempt of a lost task does no harm.

Nulls and ties: a null html is an empty payload, a null url is written as ``about:blank``; of equal payloads only with null
page_ids all are responses; several rows with the smallest page_id of a payload are all responses. Empty tables give no archive
and no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import frame, map_rows, materialize, open_fs, scratch, table

FILE_BYTES, GAP_BYTES, SPAN_BYTES, READ_BYTES = 256 << 20, 256 << 10, 16 << 20, 128 << 20
DATE = "2024-01-01T00:00:00Z"
URN = "urn:page:"
INDEX = "page_id long, file string, offset long, length long, url string, payload_digest string, record_type string, refers_to long"


def _member(page_id, url: str, payload: bytes, digest: str, size: int, refers_to=None) -> bytes:
    """One record as a gzip member: a response with its payload, or a revisit that names the response's page."""
    import zlib

    kind = "response" if refers_to is None else "revisit"
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <{URN}{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {url}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {size}",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{URN}{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    squeeze = zlib.compressobj(1, zlib.DEFLATED, 31)
    return squeeze.compress("\r\n".join(head).encode("utf-8", "replace") + block + b"\r\n\r\n") + squeeze.flush()


def _parse(member: bytes) -> dict:
    """A record's header fields in lower case, with its block."""
    import zlib

    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    fields["block"] = rest[: int(fields["content-length"])]
    return fields


def write_warc(pages: DataFrame, out_dir: str, min_revisit_bytes: int = 0) -> DataFrame:
    """Write pages (page_id, url, html) as archives below out_dir; returns the committed index."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("about:blank")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("sha", F.sha1("html"))
    groups = rows.where(F.octet_length("html") >= min_revisit_bytes).groupBy("sha").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
    first = materialize(groups.where("n > 1 AND first_id IS NOT NULL").select("sha", "first_id"), f"{out_dir}/groups")

    def pack(batches):
        import base64

        import pandas as pd

        for pdf in batches:
            out = []
            for page_id, url, html, sha in zip(pdf["page_id"], pdf["url"], pdf["html"], pdf["sha"]):
                payload, digest = html.encode("utf-8", "replace"), base64.b32encode(bytes.fromhex(sha)).decode()
                url = " ".join(url.split()) or "about:blank"
                page_id = None if pd.isna(page_id) else int(page_id)
                out.append((page_id, url, sha, digest, len(payload), _member(page_id, url, payload, digest, len(payload))))
            yield frame(out, ["page_id", "url", "sha", "digest", "size", "member"])

    packed = map_rows(rows, pack, "page_id long, url string, sha string, digest string, size long, member binary")
    joined = packed.join(first, "sha", "left").withColumn("refers_to", F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("first_id")), F.col("first_id"))).drop("first_id", "sha")

    def write(batches):
        import uuid

        import pandas as pd

        sink, at, name, fs, root = None, 0, "", None, ""
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                page_id = None if pd.isna(row.page_id) else int(row.page_id)
                refers = None if pd.isna(row.refers_to) else int(row.refers_to)
                member = row.member if refers is None else _member(page_id, row.url, b"", row.digest, row.size, refers)
                if sink is None or at + len(member) > FILE_BYTES:
                    if sink is not None:
                        sink.close()
                    if fs is None:
                        fs, root = open_fs(f"{out_dir}/archives")
                        fs.create_dir(root, recursive=True)
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    sink = fs.open_output_stream(f"{root}/{name}", compression=None)
                sink.write(member)
                out.append((page_id, f"{out_dir}/archives/{name}", at, len(member), row.url, row.digest, "response" if refers is None else "revisit", refers))
                at += len(member)
            yield frame(out, ["page_id", "file", "offset", "length", "url", "payload_digest", "record_type", "refers_to"])
        if sink is not None:
            sink.close()

    return materialize(map_rows(joined, write, INDEX), f"{out_dir}/index")


def read_warc(index: DataFrame, payloads: bool = True) -> DataFrame:
    """Read the records of (a selection of) an index back: page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload.

    A revisit's payload is null, and so is every one without payloads. payload_digest of a response is computed anew from what was read.
    """

    def read(batches):
        import base64
        import hashlib

        def number(text):
            text = text.strip("<>").removeprefix(URN)
            return int(text) if text else None

        for pdf in (x.iloc[i : i + 1000] for x in batches for i in range(0, len(x), 1000)):
            out = []
            for file, rows in pdf.sort_values(["file", "offset"]).groupby("file", sort=True):
                fs, path = open_fs(file)
                places = list(zip(rows["offset"], rows["length"]))
                with fs.open_input_file(path) as source:
                    at = 0
                    while at < len(places):
                        to, start, end = at, places[at][0], sum(places[at])
                        while to + 1 < len(places) and places[to + 1][0] - end <= GAP_BYTES and sum(places[to + 1]) - start <= SPAN_BYTES:
                            to += 1
                            end = max(end, sum(places[to]))
                        data = source.read_at(end - start, start)
                        for offset, length in places[at : to + 1]:
                            got = _parse(data[offset - start : offset - start + length])
                            payload = got["block"].partition(b"\r\n\r\n")[2]
                            response = got["warc-type"] == "response"
                            digest = base64.b32encode(hashlib.sha1(payload).digest()).decode() if response else got["warc-payload-digest"].removeprefix("sha1:")
                            out.append((number(got["warc-record-id"]), got["warc-target-uri"], len(payload) if response else int(got["x-payload-length"]), digest, got["warc-type"], None if response else number(got["warc-refers-to"]), payload if response and payloads else None))
                        at = to + 1
            yield frame(out, ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])

    size = index.agg(F.sum("length")).first()[0] or 0  # what is read, not the index's own size, sets the number of tasks
    tasks = max(-(-size // READ_BYTES), min(index.sparkSession.sparkContext.defaultParallelism, 1 + size // GAP_BYTES))
    placed = index.select("file", "offset", "length").repartitionByRange(int(tasks), "file", "offset").sortWithinPartitions("file", "offset")
    return map_rows(placed, read, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: every page written and read back."""
    index = write_warc(table(spark, sf_dir, "pages"), scratch(spark, "op3"))
    return read_warc(index, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
