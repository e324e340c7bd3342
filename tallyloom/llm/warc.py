"""WARC archives with a two-level capture index.

write_archives() writes a record for each page, each a gzip member of its own. Of pages with equal payloads of at least LEAST
bytes, that with the largest id is the response; the others are revisit records that refer to it. build_index() sorts the
captures by their reversed-host URL keys into compressed blocks of BLOCK_LINES lines, and writes a sparse directory, beside
each index file, with the first key and place of each block. lookup() finds the index file by the files' first keys, the block
by binary search in that file's directory, then reads ranges only. read_archives() reads every block and record in turn, as a
full scan does.

Null payloads are empty ones, and null URLs have the key "-". Pages that repeat with one id and payload are all responses.
Pages with a null id are responses only if no page with an id has their payload. Ids may be numbers or strings. Files that a
lost task left are in no index, as only what the written tables of captures and blocks name is ever read.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.llm.common import col, written

LEAST = 0
BLOCK_LINES = 1000
ROLL_BYTES = 256_000_000
#: Bytes of an archive that one task reads.
RANGE_BYTES = 16_000_000
#: Time of pages that have none, as in index keys.
NO_TIME = "19700101000000"

CAPTURE = T.StructType([T.StructField(n, T.StringType()) for n in ("key", "line")])
BLOCK = T.StructType([T.StructField("first_key", T.StringType()), T.StructField("file", T.StringType()), T.StructField("offset", T.LongType()), T.StructField("length", T.LongType()), T.StructField("n", T.LongType())])
RECORD = T.StructType(
    [
        T.StructField("page_id", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("refers_to", T.StringType()),
        T.StructField("payload", T.BinaryType()),
    ]
)


def url_key(url: str | None) -> str:
    """http://user@WWW.Example.com:80/a?b#c becomes com,example,www)/a?b."""
    m = re.match(r"(?s)(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#]*)([^#]*)", url or "")
    if not m:
        return "-" if not url else re.sub(r"\s", "%20", url)
    host = re.sub(r":(80|443)?$", "", m[1].lower())
    name, _, port = host.partition(":")
    path = m[2] if m[2].startswith("/") else "/" + m[2]
    return re.sub(r"\s", "%20", ",".join(reversed(name.split("."))) + (f":{port}" if port else "") + ")" + path)


def file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def date(time: str) -> str:
    """19700101000000 becomes 1970-01-01T00:00:00Z."""
    return f"{time[:4]}-{time[4:6]}-{time[6:8]}T{time[8:10]}:{time[10:12]}:{time[12:14]}Z"


def info() -> bytes:
    """The record that an archive begins with."""
    body = b"software: tallyloom\r\nformat: WARC File Format 1.1\r\n"
    head = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>", f"WARC-Date: {date(NO_TIME)}", "Content-Type: application/warc-fields", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def record(page_id: str | None, url: str | None, time: str, payload: bytes, refers_to: str | None) -> bytes:
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {date(time)}", f"WARC-Payload-Digest: sha1:{digest}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\r\n]", "", url))
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parsed(data: bytes) -> dict:
    """The columns of RECORD from the bytes of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    body = rest[: int(fields["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    ident = lambda name: m[1] if (m := re.match(r"<urn:page:(.+)>", fields.get(name, ""))) else None
    kind = fields["WARC-Type"]
    if kind == "response":
        size, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if f"sha1:{digest}" != fields["WARC-Payload-Digest"]:
            raise ValueError(f"payload of {fields['WARC-Record-ID']} does not have its digest")
    else:
        size, digest, payload = int(re.search(rb"Content-Length: (\d+)", http)[1]), fields["WARC-Payload-Digest"].removeprefix("sha1:"), None
    return {"page_id": ident("WARC-Record-ID"), "url": fields.get("WARC-Target-URI"), "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": ident("WARC-Refers-To"), "payload": payload}


def _write(path: str):
    def run(batches):
        fs, root = file_system(path)
        fs.create_dir(root, recursive=True)
        out, name, at = None, "", 0
        for batch in batches:
            keys, lines = [], []
            ids, urls, times, bodies, refers = (c.to_pylist() for c in (*batch.columns[:3], batch.column(3).cast(pa.binary()), batch.column(4)))
            for page_id, url, time, body, refer in zip(ids, urls, times, bodies, refers, strict=True):
                if out is None or at >= ROLL_BYTES:
                    if out is not None:
                        out.close()
                    name, at = f"pages-{uuid.uuid4().hex}.warc.gz", 0
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                    head = gzip.compress(info(), 6, mtime=0)
                    out.write(head)
                    at = len(head)
                data = gzip.compress(record(page_id, url, time, body or b"", refer), 6, mtime=0)
                out.write(data)
                surt = url_key(url)
                keys.append(f"{surt} {time} {'' if page_id is None else page_id.zfill(20)}")
                lines.append(json.dumps({"file": name, "offset": at, "length": len(data), "type": "response" if refer is None else "revisit"}))
                at += len(data)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(lines, pa.string())], CAPTURE.names)
        if out is not None:
            out.close()

    return run


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", time_col: str | None = None, least: int = LEAST) -> DataFrame:
    """Archives below `path` (a URI that all executors reach); returns the captures, also written there."""
    rows = pages.select(
        col(id_col).alias("id"),
        col(url_col).cast("string").alias("url"),
        (col(time_col).cast("string") if time_col else F.lit(NO_TIME)).alias("time"),
        F.coalesce(col(payload_col).cast("string"), F.lit("")).alias("payload"),
    )
    rows = rows.withColumns({"sha": F.sha1("payload"), "size": F.octet_length("payload")})
    groups = rows.where(F.col("size") >= least).groupBy("sha", "size").agg(F.max("id").alias("response"), F.count("*").alias("n")).where("n > 1 and response is not null").select("sha", "size", "response")
    # one row for each repeated payload; written, so that the join below can split a payload that many pages have
    groups = written(groups, f"{path}/groups")
    joined = rows.join(groups, ["sha", "size"], "left")
    refers = F.when(F.col("response").isNotNull() & ~F.col("id").eqNullSafe(F.col("response")), F.col("response").cast("string"))
    captures = joined.select(F.col("id").cast("string"), "url", "time", "payload", refers.alias("refers")).mapInArrow(_write(f"{path}/warc"), CAPTURE)
    return written(captures, f"{path}/captures")


def _pack(path: str):
    """Over captures sorted by key: an index file with its directory, and a row for each block."""

    def run(batches):
        fs, root = file_system(path)
        fs.create_dir(root, recursive=True)
        name, at, out = f"index-{uuid.uuid4().hex}", 0, None
        held: list[tuple[str, str]] = []
        blocks: list[tuple[str, str, int, int, int]] = []

        def flush():
            nonlocal at
            data = zlib.compress("\n".join(f"{k}\t{line}" for k, line in held).encode(), 6)
            out.write(data)
            blocks.append((held[0][0], name, at, len(data), len(held)))
            at += len(data)
            held.clear()

        for batch in batches:
            for pair in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                out = out or fs.open_output_stream(f"{root}/{name}.blocks", compression=None)
                held.append(pair)
                if len(held) == BLOCK_LINES:
                    flush()
        if held:
            flush()
        if out:
            out.close()
            with fs.open_output_stream(f"{root}/{name}.directory", compression=None) as d:
                d.write("\n".join(json.dumps([k, o, n]) for k, _, o, n, _ in blocks).encode())
        if blocks:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*blocks, strict=True), (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], BLOCK.names)

    return run


def build_index(captures: DataFrame, path: str) -> DataFrame:
    """Sorted, compressed blocks and their directories below `path`; returns the blocks, also written there."""
    parts = max(1, int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = captures.repartitionByRange(parts, "key", "line").sortWithinPartitions("key", "line")
    return written(ordered.mapInArrow(_pack(f"{path}/index"), BLOCK), f"{path}/blocks")


PLACE = T.StructType([T.StructField("key", T.StringType()), T.StructField("file", T.StringType()), T.StructField("offset", T.LongType()), T.StructField("length", T.LongType())])


def _lines(data: bytes) -> list[tuple[str, str]]:
    return [tuple(x.split("\t", 1)) for x in zlib.decompress(data).decode().split("\n")]


def _places(found: list[tuple[str, str]]) -> list[pa.Array]:
    got = [json.loads(line) for _, line in found]
    return [pa.array([k for k, _ in found], pa.string()), pa.array([g["file"] for g in got], pa.string()), pa.array([g["offset"] for g in got], pa.int64()), pa.array([g["length"] for g in got], pa.int64())]


def _unpack(path: str):
    def run(batches):
        fs, root = file_system(path)
        for batch in batches:
            for name, at, n in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True):
                with fs.open_input_file(f"{root}/{name}.blocks") as f:
                    f.seek(at)
                    yield pa.RecordBatch.from_arrays(_places(_lines(f.read(n))), PLACE.names)

    return run


def _read(path: str, with_payload: bool):
    """Over (file, offset, length) sorted by file and offset: the records there."""

    def run(batches):
        fs, root = file_system(path)
        name, f = None, None
        for batch in batches:
            out = []
            for file, at, n in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True):
                if file != name:
                    if f:
                        f.close()
                    name, f = file, fs.open_input_file(f"{root}/{file}")
                f.seek(at)
                r = parsed(gzip.decompress(f.read(n)))
                out.append(r if with_payload else r | {"payload": None})
            yield pa.RecordBatch.from_arrays([pa.array([r[x.name] for r in out], t) for x, t in zip(RECORD, (pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()), strict=True)], RECORD.names)
        if f:
            f.close()

    return run


def _records(places: DataFrame, path: str, with_payload: bool, id_type: str) -> DataFrame:
    parts = max(1, int(places.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    part = F.floor(F.col("offset") / RANGE_BYTES)
    return places.repartition(parts, "file", part).sortWithinPartitions("file", "offset").select("file", "offset", "length").mapInArrow(_read(f"{path}/warc", with_payload), RECORD).withColumns({c: F.col(c).cast(id_type) for c in ("page_id", "refers_to")})


def read_archives(spark: SparkSession, path: str, with_payload: bool = True, id_type: str = "long") -> DataFrame:
    """Every record of the archives, by way of the index: the blocks give the places, which are read in the archives' order."""
    blocks = spark.read.schema(BLOCK).parquet(f"{path}/blocks")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    places = blocks.select("file", "offset", "length").repartition(parts, "file", "offset").mapInArrow(_unpack(f"{path}/index"), PLACE)
    return _records(places, path, with_payload, id_type)


def _search(path: str):
    """Over (file, key), sorted: the places of captures with the key, by binary search in the file's directory. A block is read once for neighbouring keys."""

    def run(batches):
        fs, root = file_system(path)
        name, firsts, rows, blocks, at, lines, keys = None, [], [], None, -1, [], []
        found: list[tuple[str, str]] = []
        for batch in batches:
            for file, key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if file != name:
                    if blocks:
                        blocks.close()
                    with fs.open_input_file(f"{root}/{file}.directory") as d:
                        rows = [json.loads(x) for x in d.read().decode().split("\n")]
                    name, firsts, at, blocks = file, [r[0].encode() for r in rows], -1, fs.open_input_file(f"{root}/{file}.blocks")
                want = key.encode() + b" "
                k = max(0, bisect.bisect_left(firsts, want) - 1)
                while k < len(rows) and (firsts[k] < want or firsts[k].startswith(want)):
                    if k != at:
                        blocks.seek(rows[k][1])
                        at, lines = k, _lines(blocks.read(rows[k][2]))
                        keys = [x[0].encode() for x in lines]
                    lo = hi = bisect.bisect_left(keys, want)
                    while hi < len(keys) and keys[hi].startswith(want):
                        hi += 1
                    found += lines[lo:hi]
                    k += 1
                    if len(found) >= 5 * BLOCK_LINES:
                        yield pa.RecordBatch.from_arrays(_places(found), PLACE.names)
                        found = []
        if blocks:
            blocks.close()
        yield pa.RecordBatch.from_arrays(_places(found), PLACE.names)

    return run


def lookup(urls: DataFrame, path: str, url_col: str = "url", with_payload: bool = True, id_type: str = "long") -> DataFrame:
    """The records whose URL has the key of one of `urls`."""
    spark = urls.sparkSession
    blocks = spark.read.schema(BLOCK).parquet(f"{path}/blocks")
    files = sorted((r.first.encode(), r.last.encode(), r.file) for r in blocks.groupBy("file").agg(F.min("first_key").alias("first"), F.max("first_key").alias("last")).collect())  # a row for each sort task
    firsts = [f[0] for f in files]

    def route(batches):
        for batch in batches:
            out = []
            for url in batch.column(0).to_pylist():
                want = url_key(url).encode() + b" "
                k = max(0, bisect.bisect_left(firsts, want) - 1)
                while k < len(files) and (firsts[k] < want or firsts[k].startswith(want)):
                    out.append((files[k][2], want[:-1].decode()))
                    k += 1
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.string())], ["file", "key"])

    routed = urls.select(col(url_col).cast("string")).mapInArrow(route, "file string, key string").distinct()
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    places = routed.repartition(parts, "file").sortWithinPartitions("file", "key").mapInArrow(_search(f"{path}/index"), PLACE)
    return _records(places, path, with_payload, id_type)
