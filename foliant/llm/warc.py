"""Operator 10: WARC archives with a two-level capture index.

Each task writes the records it has as one archive, a gzip member a record; payloads are not moved for it unless the
table of repeated payloads is too large to send to every task. Captures, a few numbers each, are then sorted by their
key, the URL with its host's labels reversed, and written in compressed blocks, with a sparse directory of the blocks at
each index file's end. A lookup goes by the index files' first keys to a file and by binary search in its directory to
blocks; blocks are dealt out, so that a key of very many captures is read by many tasks, and searched for their captures,
whose ranges are then read in the archives' order and in one piece where they lie side by side.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from bisect import bisect_left, bisect_right
from functools import lru_cache

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import scratch_path, sliced, written

#: Payloads of fewer bytes are always written in full.
LEAST_BYTES = 1000
#: Captures in a block of the index.
BLOCK_LINES = 1000
#: Ranges of one archive that are so close are read as one, up to so many bytes.
GAP, PIECE = 1 << 16, 1 << 24
#: Blocks of the index, and bytes of archives, that a task reads.
TASK_BLOCKS, TASK_BYTES = 8, 1 << 24
CRLF = b"\r\n"


def surt(url: Column) -> Column:
    """com,example,www)/path?query: host labels reversed, A-Z lower-cased in them, scheme and fragment gone; empty for null."""
    host = F.translate(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rest = F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^#]*)", 1)
    known = F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest)
    return F.coalesce(F.when(F.instr(url, "://") > 0, known).otherwise(url), F.lit(""))


def _file(path: str):
    """File system and path of a URI or a local path; s3a and s3n are Spark's names of s3."""
    path = path.replace("s3a://", "s3://", 1).replace("s3n://", "s3://", 1)
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record; a revisit has no payload."""
    http = CRLF.join([b"HTTP/1.1 200 OK", b"Content-Type: text/html; charset=utf-8", b"Content-Length: %d" % size, b"", b""])
    block = http if revisit else http + payload
    head = [b"WARC/1.1", b"WARC-Type: " + (b"revisit" if revisit else b"response"), b"WARC-Record-ID: <urn:page:%s>" % (b"" if page_id is None else b"%d" % page_id)]
    head += [b"WARC-Date: 1970-01-01T00:00:00Z", b"WARC-Target-URI: " + " ".join((url or "").splitlines()).encode(), b"WARC-Payload-Digest: sha1:" + digest.encode(), b"X-Payload-Length: %d" % size]
    if revisit:
        head += [b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", b"WARC-Refers-To: <urn:page:%d>" % refers_to]
    head += [b"Content-Type: application/http; msgtype=response", b"Content-Length: %d" % len(block), b"", b""]
    return CRLF.join(head) + block + CRLF + CRLF


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    """A record's header fields and payload."""
    head, _, rest = data.partition(CRLF + CRLF)
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    return fields, block.partition(CRLF + CRLF)[2]


def _gzip(data: bytes) -> bytes:
    c = zlib.compressobj(5, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def _archived(folder: str):
    names = ["key", "page", "file", "offset", "length"]

    def run(batches):
        out, at, name = None, 0, f"{folder}/{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
        try:
            for batch in sliced(batches):
                rows, spans = batch.to_pylist(), []
                for r in rows:
                    if out is None:
                        system, path = _file(name)
                        out = system.open_output_stream(path, compression=None)
                    data = _gzip(record(r["page"], r["url"], r["payload"], r["digest"], r["size"], r["keeper"], r["revisit"]))
                    out.write(data)
                    spans.append((at, len(data)))
                    at += len(data)
                n = len(rows)
                cols = [batch.column("key"), batch.column("page"), pa.array([name] * n, pa.string()), pa.array([a for a, _ in spans], pa.int64()), pa.array([b for _, b in spans], pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names)
        finally:
            if out is not None:
                out.close()

    return run


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Writes a record for each row and returns its capture (key, page, file, offset, length).

    Of records with equal payloads of least_bytes or more, those with the largest id are responses and the others
    revisits of it; without any id among them all are responses. A null payload is an empty one, a null url has an
    empty key. Repeated rows are written again. A task that runs twice leaves a file that no capture names.
    """
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("page"), F.col(url_col).alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"size": F.octet_length("payload").cast("long"), "digest": F.sha1("payload"), "key": surt(F.col("url"))})
    long_ones = rows.where(F.col("size") >= least_bytes)
    groups = long_ones.groupBy(F.unhex("digest").alias("d"), F.col("size").alias("s")).agg(F.max("page").alias("keeper"), F.count(F.lit(1)).alias("n"))
    groups = written(groups.where("n > 1").select("d", "s", "keeper"), "repeated-payloads")
    rows = rows.join(groups, (F.unhex("digest") == F.col("d")) & (F.col("size") == F.col("s")), "left")
    revisit = F.coalesce(F.col("keeper").isNotNull() & ~F.col("page").eqNullSafe(F.col("keeper")), F.lit(False))
    rows = rows.select("key", "page", "url", F.when(~revisit, F.col("payload")).alias("payload"), "digest", "size", F.when(revisit, F.col("keeper")).alias("keeper"), revisit.alias("revisit"))
    system, path = _file(folder)
    system.create_dir(path)
    return written(rows.mapInArrow(_archived(folder), "key string, page long, file string, offset long, length long"), "captures")


def _blocked(folder: str, lines: int):
    """Writes sorted captures as an index file: blocks, the directory, its length."""

    def run(batches):
        name = f"{folder}/{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.cdx"
        out, at, held, directory, last = None, 0, [], [], None

        def flush():
            nonlocal at
            data = zlib.compress(json.dumps(held).encode())
            out.write(data)
            directory.append([held[0][0], at, len(data)])
            at += len(data)
            held.clear()

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    system, path = _file(name)
                    out = system.open_output_stream(path, compression=None)
                held.append(row)
                last = row[0]
                if len(held) == lines:
                    flush()
        if out is not None:
            if held:
                flush()
            data = zlib.compress(json.dumps(directory).encode())
            out.write(data + len(data).to_bytes(8, "big"))
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (name, directory[0][0], last, len(directory))], ["file", "first_key", "last_key", "blocks"])

    return run


def write_index(captures: DataFrame, folder: str, lines: int = BLOCK_LINES) -> list[tuple[str, str, str, int]]:
    """Writes the index and returns (first key, last key, file, blocks) of its files, one for each partition at most."""
    system, path = _file(folder)
    system.create_dir(path)
    order = ["key", "page", "file", "offset"]
    rows = captures.select("key", "page", "file", "offset", "length").repartitionByRange(*order).sortWithinPartitions(*order)
    files = written(rows.mapInArrow(_blocked(folder, lines), "file string, first_key string, last_key string, blocks long"), "index-files")
    return sorted((r.first_key, r.last_key, r.file, r.blocks) for r in files.collect())


@lru_cache(maxsize=64)
def _open(name: str):
    system, path = _file(name)
    return system.open_input_file(path)


@lru_cache(maxsize=256)
def _directory(name: str) -> list[list]:
    f = _open(name)
    n = f.size()
    length = int.from_bytes(f.read_at(8, n - 8), "big")
    return json.loads(zlib.decompress(f.read_at(length, n - 8 - length)))


@lru_cache(maxsize=32)
def _block(name: str, offset: int, length: int) -> list[list]:
    return json.loads(zlib.decompress(_open(name).read_at(length, offset)))


def blocks_of(key: str, files: list[tuple[str, str, str, int]]):
    """(index file, offset, length) of the blocks that can hold a key; its captures may run over many blocks and files."""
    k = bisect_left(files, key, key=lambda f: f[1])  # the first file that ends at the key or after it
    while k < len(files) and files[k][0] <= key:
        directory = _directory(files[k][2])
        b = max(bisect_left(directory, key, key=lambda d: d[0]) - 1, 0)
        while b < len(directory) and directory[b][0] <= key:
            yield files[k][2], directory[b][1], directory[b][2]
            b += 1
        k += 1


def lookup(urls: DataFrame, files: list[tuple[str, str, str, int]], url_col: str = "url") -> DataFrame:
    """(key, page, file, offset, length): the captures of every distinct key of urls; none for an unknown one.

    Keys are looked up in order, so that a task opens few directories, and their blocks in order, each read once.
    """

    def placed(batches):
        for batch in batches:
            found = [(key, *block) for key in batch.column(0).to_pylist() for block in blocks_of(key, files)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64(), pa.int64()))], ["key", "index", "at", "size"])

    def searched(batches):
        names, kinds = ["key", "page", "file", "offset", "length"], [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        for batch in batches:
            found = []
            for key, *block in zip(*(batch.column(i).to_pylist() for i in range(4))):
                held = _block(*block)
                found += held[bisect_left(held, key, key=lambda c: c[0]) : bisect_right(held, key, key=lambda c: c[0])]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], t) for i, t in enumerate(kinds)], names)

    keys = urls.select(surt(F.col(url_col)).alias("key")).distinct().repartitionByRange("key").sortWithinPartitions("key")
    places = keys.mapInArrow(placed, "key string, index string, at long, size long")
    tasks = max(1, -(-sum(f[3] for f in files) // TASK_BLOCKS))
    return places.repartitionByRange(tasks, "index", "at").sortWithinPartitions("index", "at").mapInArrow(searched, "key string, page long, file string, offset long, length long")


def _ranges(batches):
    """(file, offset, data) of each capture, neighbours read in one piece."""
    name, start, held = None, 0, []

    def flush():
        end = held[-1][0] + held[-1][1]
        data = _open(name).read_at(end - start, start)
        for at, length in held:
            yield data[at - start : at - start + length]

    for batch in batches:
        for file, offset, length in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length"))):
            if held and (file != name or offset - held[-1][0] - held[-1][1] > GAP or offset + length - start > PIECE):
                yield from flush()
                held = []
            if not held:
                name, start = file, offset
            held.append((offset, length))
    if held:
        yield from flush()


def _read(batches):
    kinds = {"page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "payload": pa.binary()}
    rows, held = [], 0

    def out():
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds.values())], list(kinds))

    def page(urn: str | None) -> int | None:
        n = urn and urn.removeprefix("<urn:page:").removesuffix(">")
        return int(n) if n else None

    for data in _ranges(batches):
        fields, payload = parsed(zlib.decompress(data, 31))
        digest, size = fields["WARC-Payload-Digest"].removeprefix("sha1:"), int(fields["X-Payload-Length"])
        if fields["WARC-Type"] == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
            raise ValueError(f"the record of {fields['WARC-Record-ID']} is damaged")
        revisit = fields["WARC-Type"] == "revisit"
        rows.append((page(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], size, digest, fields["WARC-Type"], page(fields.get("WARC-Refers-To")), None if revisit else payload))
        held += len(payload)
        if len(rows) == 1000 or held > PIECE:
            yield out()
            rows, held = [], 0
    yield out()


def read_records(captures: DataFrame) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload) of each capture, read by range.

    Captures are dealt out by archive and offset, a few numbers each, to as many tasks as their bytes need. The digest
    of every payload is checked. A revisit's payload is null.
    """
    order = ["file", "offset"]
    rows = written(captures.select("file", "offset", "length"), "captures-to-read")
    tasks = max(1, -(-(rows.agg(F.sum("length")).first()[0] or 0) // TASK_BYTES))
    rows = rows.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    return rows.mapInArrow(_read, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def archive(spark: SparkSession, pages: DataFrame, folder: str | None = None, **kw) -> list[tuple[str, str, str, int]]:
    """Writes archives and index under folder, by default one in the shared folder; returns the index's files."""
    folder = folder or scratch_path(spark, "warc")
    return write_index(write_archives(pages, f"{folder}/archives", **kw), f"{folder}/index")
