"""WARC archives with a two-level capture index.

``write_archive`` writes one WARC file of gzip members per task and, per capture, an index line under
its reversed-host key (``com,example,www)/path``).  The lines are range-partitioned by (key, capture)
and every partition becomes one index file: compressed blocks of ``BLOCK`` lines, and at its end a
sparse directory with the first key of every block.  ``lookup`` sorts the asked keys the same way,
finds the index file and the block by binary search, and reads just that block and the records it
names, each with one range read.

Equal payloads of at least ``least`` bytes are stored once: the record with the largest page_id is a
``response``, the others are ``revisit`` records that name it.

Cases: null html is an empty payload; a null url has the key ``-``; a null page_id is a capture of
its own, never refers to others and is never referred to; rows sharing the largest page_id of a
payload are all responses; repeated rows are repeated records, returned once each; an empty table
gives an empty archive.  Other columns are ignored.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepfall.plans.materialize import cut, scratch

LEAST_BYTES = 1000
BLOCK = 512                 # index lines in a compressed block
READ_BYTES = 4 << 20        # archive bytes that one task reads back, about
NO_CAPTURE = -1             # how a null page_id sorts and is stored
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

CAPTURE = ("key binary, capture long, null_id boolean, file string, start long, length long, "
           "record_type string")
BLOCKS = ("first_key binary, first_capture long, file string, start long, length long, "
          "record_bytes long")
RECORD = ("page_id long, payload_bytes long, payload_digest string, record_type string, "
          "refers_to long, url string, file string, start long, length long")


@dataclass
class Archive:
    """Where an archive lies: its index files in key order, with their first key and directory."""

    files: list[tuple[bytes, int, str, int, int]]
    record_bytes: int


def reversed_host_key(url: str | None) -> bytes:
    """Sort key of a capture: host labels reversed, then the rest of the address."""
    if not url:
        return b"-"
    try:
        parts = urlsplit(url if "//" in url else "//" + url)
        host, port = (parts.hostname or "").rstrip("."), parts.port
    except ValueError:
        return url.encode("utf-8", "replace")
    port = f":{port}" if port and port not in (80, 443) else ""
    path = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    return f"{','.join(reversed(host.split('.')))}{port}){path}".encode("utf-8", "replace")


def _file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = uri.removeprefix("file:")             # how Spark spells a local path
    return pafs.FileSystem.from_uri(uri)


def _header(fields: dict[str, object], first: str = "WARC/1.1") -> bytes:
    clean = ("".join(c if c.isprintable() else f"%{ord(c):02X}" for c in f"{k}: {v}")
             for k, v in fields.items())
    return ("\r\n".join([first, *clean]) + "\r\n\r\n").encode("utf-8", "replace")


def _urn(page: int | None, salt: str = "") -> str:
    return f"<{uuid.uuid5(uuid.NAMESPACE_OID, f'{page}{salt}').urn}>"


def record_bytes(page: int | None, url: str | None, html: str | None, refers_to: int | None,
                 size: int, digest: str) -> bytes:
    """One gzip member: a response with its payload, or a revisit with the HTTP header alone."""
    revisit = refers_to is not None
    payload = b"" if revisit or html is None else html.encode("utf-8")
    http = _header({"Content-Type": "text/html; charset=utf-8", "Content-Length": size},
                   "HTTP/1.1 200 OK")
    fields: dict[str, object] = {
        "WARC-Type": "revisit" if revisit else "response", "WARC-Record-ID": _urn(page),
        "WARC-Date": DATE, "WARC-Target-URI": url or "-",
        "WARC-Payload-Digest": "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode(),
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": len(http) + len(payload)}
    if page is not None:
        fields["X-Page-Id"] = page
    if revisit:
        fields |= {"WARC-Profile": PROFILE, "WARC-Refers-To": _urn(refers_to),
                   "X-Refers-To-Page-Id": refers_to}
    return gzip.compress(_header(fields) + http + payload + b"\r\n\r\n", compresslevel=5, mtime=0)


def _write_records(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _file_system(folder)
        out, name, at = None, f"{root}/{uuid.uuid4().hex}.warc.gz", 0
        uri = f"{folder}/{name.rsplit('/', 1)[1]}"
        for batch in batches:
            if out is None:
                out = fs.open_output_stream(name, compression=None)
            lines = []
            for row in batch.to_pylist():
                data = record_bytes(row["page_id"], row["url"], row["html"], row["refers_to"],
                                    row["size"], row["digest"])
                out.write(data)
                page = row["page_id"]
                lines.append((reversed_host_key(row["url"]), NO_CAPTURE if page is None else page,
                              page is None, uri, at, len(data),
                              "response" if row["refers_to"] is None else "revisit"))
                at += len(data)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(zip(*lines), (
                    pa.binary(), pa.int64(), pa.bool_(), pa.string(), pa.int64(), pa.int64(),
                    pa.string()))],
                ["key", "capture", "null_id", "file", "start", "length", "record_type"]) \
                if lines else pa.RecordBatch.from_pylist([], _arrow(CAPTURE))
        if out is not None:
            out.close()
    return run


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(),
             "boolean": pa.bool_()}
    return pa.schema([(n, kinds[t]) for n, t in (f.split() for f in ddl.split(", "))])


def _write_index(folder: str, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _file_system(folder)
        out, name, at, held = None, f"{root}/{uuid.uuid4().hex}.cdx.gz", 0, 0
        uri, directory, lines = f"{folder}/{name.rsplit('/', 1)[1]}", [], []

        def flush() -> None:
            nonlocal at
            if lines:
                data = gzip.compress("\n".join(json.dumps(x) for x in lines).encode(), 5, mtime=0)
                out.write(data)
                directory.append((lines[0][0], lines[0][1], at, len(data)))
                at += len(data)
                lines.clear()

        for batch in batches:
            out = out or fs.open_output_stream(name, compression=None)
            for r in batch.to_pylist():
                held += r["length"]
                lines.append((r["key"].hex(), r["capture"], r["null_id"], r["file"], r["start"],
                              r["length"], r["record_type"]))
                if len(lines) == block:
                    flush()
        if out is not None:
            flush()
            data = gzip.compress(json.dumps(directory).encode(), 5, mtime=0)
            out.write(data)
            out.close()
            if directory:
                yield pa.RecordBatch.from_pylist([{
                    "first_key": bytes.fromhex(directory[0][0]), "first_capture": directory[0][1],
                    "file": uri, "start": at, "length": len(data), "record_bytes": held}],
                    _arrow(BLOCKS))
    return run


def write_archive(pages: DataFrame, *, page_id: str = "page_id", url: str = "url",
                  html: str = "html", least: int = LEAST_BYTES, block: int = BLOCK) -> Archive:
    """Write records and index; returns where they lie (one entry per index file)."""
    spark = pages.sparkSession
    folder = scratch(spark)
    fs, root = _file_system(folder)
    fs.create_dir(root, recursive=True)
    payload = F.coalesce(F.col(html), F.lit(""))
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"),
                        F.col(html).alias("html"), F.octet_length(payload).cast("long").alias("size"),
                        F.sha1(F.encode(payload, "UTF-8")).alias("digest"))
    shared = cut(rows.filter(F.col("size") >= least).groupBy("digest").agg(
        F.max("page_id").alias("keeper"), F.count("page_id").alias("n")).filter("n > 1")
        .select("digest", "keeper"))
    linked = rows.join(shared, "digest", "left").withColumn(
        "refers_to", F.when((F.col("size") >= least) & (F.col("page_id") != F.col("keeper")),
                            F.col("keeper")))
    records = linked.select("page_id", "url", F.when(F.col("refers_to").isNull(), F.col("html"))
                            .alias("html"), "size", "digest", "refers_to")
    captures = cut(records.mapInArrow(_write_records(folder), CAPTURE))
    index = captures.repartitionByRange("key", "capture").sortWithinPartitions("key", "capture") \
        .mapInArrow(_write_index(folder, block), BLOCKS)
    # One row per index file, that is per task of the job above.
    found = index.collect()
    return Archive(sorted((bytes(r.first_key), r.first_capture, r.file, r.start, r.length) for r in found),
                   sum(r.record_bytes for r in found))


def _range(fs_cache: dict, uri: str, start: int, length: int) -> bytes:
    if uri not in fs_cache:
        if len(fs_cache) > 256:
            fs_cache.popitem()[1].close()
        fs, path = _file_system(uri)
        fs_cache[uri] = fs.open_input_file(path)
    return fs_cache[uri].read_at(length, start)


def parse_record(data: bytes) -> dict:
    """Fields of one gzip member; checks a response's payload against its digest."""
    raw = gzip.decompress(data)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[:int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(http.rpartition(b"Content-Length: ")[2])
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    number = lambda name: int(fields[name]) if name in fields else None
    return {"page_id": number("X-Page-Id"), "payload_bytes": size, "payload_digest": digest,
            "record_type": kind, "refers_to": number("X-Refers-To-Page-Id"),
            "url": fields["WARC-Target-URI"], "payload": payload}


def _find(archive: Archive, batch_rows: int = 512):
    firsts = [(k, c) for k, c, *_ in archive.files]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: dict = {}
        loaded, directory, heads = -1, [], []
        cached: tuple[tuple[int, int], list] = ((-1, -1), [])
        found: list[dict] = []
        schema = _arrow(RECORD)
        for batch in batches:
            for ask in batch.to_pylist():
                want = (bytes(ask["key"]), ask["capture"])
                # captures equal to the asked one may begin in the file or block before
                part = max(bisect.bisect_left(firsts, want) - 1, 0)
                while part < len(firsts):
                    if loaded != part:
                        _, _, uri, start, length = archive.files[part]
                        directory = json.loads(gzip.decompress(_range(opened, uri, start, length)))
                        loaded, heads = part, [(bytes.fromhex(k), c) for k, c, _, _ in directory]
                    at, past = max(bisect.bisect_left(heads, want) - 1, 0), False
                    while at < len(heads) and not past:
                        if cached[0] != (part, at):
                            uri = archive.files[part][2]
                            _, _, start, length = directory[at]
                            lines = [(bytes.fromhex(x[0]), *x[1:]) for x in map(
                                json.loads, gzip.decompress(
                                    _range(opened, uri, start, length)).decode().split("\n"))]
                            cached = ((part, at), lines)
                        lines = cached[1]
                        keys = [(x[0], x[1]) for x in (lines[0], lines[-1])]
                        if keys[0] > want:
                            past = True
                            break
                        i = bisect.bisect_left(lines, want, key=lambda x: (x[0], x[1]))
                        while i < len(lines) and (lines[i][0], lines[i][1]) == want:
                            if lines[i][2] == ask["null_id"]:
                                _, _, _, file, start, length, _ = lines[i]
                                r = parse_record(_range(opened, file, start, length))
                                r.pop("payload")
                                found.append(r | {"file": file, "start": start, "length": length})
                            i += 1
                        past = i < len(lines)
                        at += 1
                    if past or (part + 1 < len(firsts) and firsts[part + 1] > want):
                        break
                    part += 1
                if len(found) >= batch_rows:
                    yield pa.RecordBatch.from_pylist(found, schema)
                    found = []
        yield pa.RecordBatch.from_pylist(found, schema)
        for f in opened.values():
            f.close()
    return run


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        urls, ids = batch.column("url").to_pylist(), batch.column("page_id").to_pylist()
        yield pa.RecordBatch.from_arrays(
            [pa.array([reversed_host_key(u) for u in urls], pa.binary()),
             pa.array([NO_CAPTURE if i is None else i for i in ids], pa.int64()),
             pa.array([i is None for i in ids], pa.bool_())], ["key", "capture", "null_id"])


def lookup(spark: SparkSession, archive: Archive, asked: DataFrame) -> DataFrame:
    """Records of the asked captures (``url, page_id``), each distinct capture asked once.

    Asked keys are range-partitioned like the index, so that a task reads each of its blocks once.  The
    keys are tiny beside the records they lead to, so the archive's size sets the number of tasks.
    """
    tasks = max(1, -(-archive.record_bytes // READ_BYTES))
    keys = asked.select("url", F.col("page_id").cast("long").alias("page_id")).mapInArrow(
        _keys, "key binary, capture long, null_id boolean").distinct()
    return keys.repartitionByRange(tasks, "key", "capture").sortWithinPartitions("key", "capture") \
        .mapInArrow(_find(archive), RECORD)
