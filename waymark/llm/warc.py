"""WARC archives: whole-file gzip streams, their normalisation and a sidecar offset index."""

from __future__ import annotations

import base64
import hashlib
import json
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import scratch, slices, stored
from waymark.llm.files import make_folder, read_file, write_file

#: Payload bytes of one archive at most, unless one record alone has more.
ARCHIVE_BYTES = 32 << 20
DATE = "2024-01-01T00:00:00Z"

# Fixed values of the WARC 1.1 format.
_VERSION = "WARC/1.1"
_REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_RESPONSE_TYPE = "application/http;msgtype=response"
_EOL = b"\r\n"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _uri(url: str | None) -> str:
    """The URL with white space, controls and other characters that a header line cannot
    carry percent-encoded."""
    data = (url or "about:blank").encode()
    return "".join(chr(b) if 0x21 <= b < 0x7F else f"%{b:02X}" for b in data)


def _id(page_id) -> str:
    return f"<urn:waymark:page:{'none' if page_id is None else page_id}>"


def _page(record_id: str):
    text = record_id.rpartition(":")[2].rstrip(">")
    return None if text == "none" else int(text)


def record(page_id, url: str | None, payload: bytes, refers_to=None, revisit: bool = False) -> bytes:
    """One record: a response with its payload, or a revisit with the HTTP header only."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = [
        _VERSION, f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_id(page_id)}",
        f"WARC-Date: {DATE}", f"WARC-Target-URI: {_uri(url)}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}", f"WARC-Block-Digest: sha1:{digest(block)}",
    ]
    if revisit:
        head += [f"WARC-Refers-To: {_id(refers_to)}", f"WARC-Profile: {_REVISIT_PROFILE}"]
    head += [f"Content-Type: {_RESPONSE_TYPE}", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + 2 * _EOL


def parse(data: bytes, at: int = 0) -> tuple[dict, bytes, int]:
    """Headers (lower-case names), block and end of the record at `at`."""
    stop = data.index(2 * _EOL, at)
    lines = data[at:stop].decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no record at {at}")
    headers = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    start = stop + 4
    end = start + int(headers["content-length"])
    return headers, data[start:end], end + 4


def records(stream: bytes, chunk: int = 1 << 20):
    """Inflate a gzip file once, whatever its members, and yield its records one by one.

    No more than one record and a chunk are held."""
    held, need = bytearray(), 0
    for piece in _inflated(stream, chunk):
        held += piece
        while len(held) >= max(need, 1):
            stop = held.find(b"\r\n\r\n")
            if stop < 0:
                break
            need = stop + 8 + next(
                int(x.partition(b":")[2]) for x in bytes(held[:stop]).split(b"\r\n")
                if x.lower().startswith(b"content-length:")
            )
            if len(held) < need:
                break
            yield bytes(held[:need])
            del held[:need]
            need = 0
    if held:
        raise ValueError("the archive ends inside a record")


def _inflated(stream: bytes, chunk: int):
    """The bytes of a gzip file piece by piece, over all its members."""
    at = 0
    while at < len(stream):
        inflate = zlib.decompressobj(31)
        while not inflate.eof:
            if at >= len(stream):
                raise ValueError("the archive ends inside a gzip member")
            part = stream[at:at + chunk]
            at += len(part)
            yield inflate.decompress(part)
        at -= len(inflate.unused_data)


def normalise(stream: bytes) -> tuple[bytes, list[dict]]:
    """Rewrite a whole-file gzip archive with one member per record; index of the members."""
    out, index, here = [], [], 0
    for raw in records(stream):
        headers, _, _ = parse(raw)
        packer = zlib.compressobj(6, zlib.DEFLATED, 31)
        member = packer.compress(raw) + packer.flush()
        index.append({"id": headers["warc-record-id"], "type": headers["warc-type"], "offset": here, "length": len(member)})
        out.append(member)
        here += len(member)
    return b"".join(out), index


# ---------------------------------------------------------------- jobs

def plan_revisits(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, url, payload (bytes), keep_id: the page_id of the record that holds an equal
    payload, null where the page holds its own.

    Equal payloads of at least `least` bytes form a group; its largest page_id holds it. Rows
    that repeat that page_id are responses as well. Null page_ids are the smallest; a group
    without page_ids is all responses. The group's holder comes from an aggregate that each
    task starts by itself and one join on the digest, whose hot keys Spark can split.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("_sha", F.sha1("payload"))
    keepers = rows.where(F.length("payload") >= least).groupBy("_sha").agg(
        F.max("page_id").alias("_keep"), F.count("*").alias("_n")
    ).where("_n > 1").drop("_n")
    joined = rows.join(keepers, "_sha", "left")
    own = F.col("_keep").isNull() | F.col("page_id").eqNullSafe(F.col("_keep"))
    return joined.select("page_id", "url", "payload", F.when(~own, F.col("_keep")).alias("keep_id"))


def write_archives(planned: DataFrame, folder: str) -> DataFrame:
    """Write monolithic archives, one gzip stream per file; returns one row per file."""
    make_folder(folder)

    def write(batches):
        from pyspark import TaskContext

        part, piece = TaskContext.get().partitionId(), 0
        packer, out, held, n = zlib.compressobj(6, zlib.DEFLATED, 31), [], 0, 0

        def flush():
            nonlocal packer, out, held, n, piece
            file = f"{folder}/raw-{part:06d}-{piece:04d}.warc.gz"
            write_file(file, b"".join(out) + packer.flush())
            row = pa.RecordBatch.from_pydict({"file": [file], "n_records": [n]})
            packer, out, held, n, piece = zlib.compressobj(6, zlib.DEFLATED, 31), [], 0, 0, piece + 1
            return row

        for batch in slices(batches, "payload"):
            for page, url, payload, keep in zip(*(c.to_pylist() for c in batch.columns)):
                if n and held + len(payload) > ARCHIVE_BYTES:
                    yield flush()
                out.append(packer.compress(record(page, url, payload, keep, keep is not None)))
                held, n = held + len(payload), n + 1
        if n:
            yield flush()

    return stored(planned.mapInArrow(write, "file string, n_records long"), "warc-files")


def normalise_archives(files: DataFrame) -> DataFrame:
    """Rewrite every archive with one member per record and a sidecar index (JSON lines);
    returns one row per archive: (file, index, n_records)."""

    def rewrite(batches):
        for batch in batches:
            for file in batch.column("file").to_pylist():
                data, index = normalise(read_file(file))
                new = file.replace("/raw-", "/warc-")
                write_file(new, data)
                write_file(f"{new}.idx", "".join(json.dumps(x) + "\n" for x in index).encode())
                yield pa.RecordBatch.from_pydict({"file": [new], "index": [f"{new}.idx"], "n_records": [len(index)]})

    spread = files.repartition(max(1, files.sparkSession.sparkContext.defaultParallelism * 2), "file")
    return stored(spread.mapInArrow(rewrite, "file string, index string, n_records long"), "warc-normal")


def read_archives(normal: DataFrame, batch_rows: int = 200) -> DataFrame:
    """Read every record of the normalised archives through its index entry.

    payload is that of the block (null for revisits); payload_bytes is what the record's HTTP
    header states, so revisits tell the full payload's length too."""

    def read(batches):
        names = ["page_id", "url", "record_type", "payload_digest", "refers_to", "payload_bytes", "payload"]
        for batch in batches:
            for file, index in zip(batch.column("file").to_pylist(), batch.column("index").to_pylist()):
                data, rows = read_file(file), []
                for entry in read_file(index).decode().splitlines():
                    e = json.loads(entry)
                    headers, block, _ = parse(zlib.decompress(data[e["offset"]:e["offset"] + e["length"]], 31))
                    http, _, payload = block.partition(2 * _EOL)
                    stated = int(http.lower().rpartition(b"content-length:")[2])
                    kind = headers["warc-type"]
                    back = headers.get("warc-refers-to")
                    rows.append((
                        _page(headers["warc-record-id"]), headers["warc-target-uri"], kind,
                        headers["warc-payload-digest"].partition(":")[2], _page(back) if back else None,
                        stated, payload if kind == "response" else None,
                    ))
                    if len(rows) == batch_rows:
                        yield _batch(names, rows)
                        rows = []
                if rows:
                    yield _batch(names, rows)

    spread = normal.repartition(max(1, normal.sparkSession.sparkContext.defaultParallelism * 2), "file")
    return spread.mapInArrow(
        read,
        "page_id long, url string, record_type string, payload_digest string, refers_to long, "
        "payload_bytes long, payload binary",
    )


def _batch(names, rows):
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def archive_digest(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write, normalise and read back the archives of `pages` (page_id, url, html)."""
    folder = scratch(pages.sparkSession, "warc")
    normal = normalise_archives(write_archives(plan_revisits(pages, least), folder))
    return read_archives(normal).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
