"""WARC records in ZIP-packaged archives: writer and range reader.

A package is a ZIP file with the stored members ``archive/data.warc.gz``
(one gzip member per record), ``indexes/index.cdxj`` (offset and length of
each record) and ``datapackage.json``.  The reader parses the end-of-directory
records, ZIP64 forms included, and the central directory, finds where the
stored members begin, reads the index and then reads each record by its byte
range; nothing is extracted.

Files are opened through the file system that the path names, in the folder
that driver and executors share.  A task writes under a name of its own, and
only the names of finished tasks reach the manifest, so a task that is lost
and run again leaves no double records.

Defined cases: a null payload is empty; a null url is written as the record's
own urn; rows that tie at the largest page_id of equal payloads are all
responses; a null page_id is below all others and stays null; an empty table
gives no packages and no records; other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import re
import struct
import uuid
import zipfile
import zlib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import materialize

ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: Compressed bytes after which a task begins a new package.
PACKAGE_BYTES = 32 << 20
#: Equal payloads below this size are all written in full.
MIN_REVISIT_BYTES = 0
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

# Fixed values of the ZIP format.
_EOCD, _EOCD64, _LOCATOR64, _CENTRAL, _LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
_FULL16, _FULL32 = 0xFFFF, 0xFFFFFFFF


def open_path(path: str):
    """(file system, path inside it) of a URI or a plain path."""
    from pyarrow import fs
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


# -- reading ZIP directories ------------------------------------------------

def _at(f, offset: int, n: int) -> bytes:
    f.seek(offset)
    return f.read(n)


def members(f, size: int) -> dict[str, tuple[int, int, int, int]]:
    """name -> (method, stored size, full size, offset of the local header)."""
    tail_at = max(0, size - 22 - _FULL16)
    tail = _at(f, tail_at, size - tail_at)
    end = tail.rfind(_EOCD)
    while end >= 0 and (len(tail) < end + 22 or end + 22 + struct.unpack_from("<H", tail, end + 20)[0] != len(tail)):
        end = tail.rfind(_EOCD, 0, end)
    if end < 0:
        raise ValueError("no end-of-directory record: not a ZIP file")
    count, length, offset = struct.unpack_from("<HII", tail, end + 10)
    if count == _FULL16 or length == _FULL32 or offset == _FULL32:
        loc = _at(f, tail_at + end - 20, 20)
        if loc[:4] != _LOCATOR64:
            raise ValueError("a ZIP64 directory without its locator")
        rec = _at(f, struct.unpack_from("<Q", loc, 8)[0], 56)
        if rec[:4] != _EOCD64:
            raise ValueError("no ZIP64 end-of-directory record where the locator points")
        count, length, offset = struct.unpack_from("<QQQ", rec, 32)
    raw, pos, out = _at(f, offset, length), 0, {}
    for _ in range(count):
        if raw[pos:pos + 4] != _CENTRAL:
            raise ValueError("the central directory is damaged")
        method = struct.unpack_from("<H", raw, pos + 10)[0]
        stored, full, n_name, n_extra, n_note = struct.unpack_from("<IIHHH", raw, pos + 20)
        header = struct.unpack_from("<I", raw, pos + 42)[0]
        name = raw[pos + 46:pos + 46 + n_name].decode("utf-8")
        extra = raw[pos + 46 + n_name:pos + 46 + n_name + n_extra]
        at = 0
        while at + 4 <= len(extra):
            kind, n = struct.unpack_from("<HH", extra, at)
            if kind == 1:              # ZIP64: only the fields that are full above, in this order
                wide = iter(struct.unpack_from(f"<{n // 8}Q", extra, at + 4))
                full = next(wide) if full == _FULL32 else full
                stored = next(wide) if stored == _FULL32 else stored
                header = next(wide) if header == _FULL32 else header
            at += 4 + n
        out[name] = (method, stored, full, header)
        pos += 46 + n_name + n_extra + n_note
    return out


def stored_at(f, member: tuple[int, int, int, int]) -> int:
    """Where a stored member's bytes begin."""
    if member[0]:
        raise ValueError("only stored members can be read by ranges")
    head = _at(f, member[3], 30)
    if head[:4] != _LOCAL:
        raise ValueError("no local header where the directory points")
    return member[3] + 30 + sum(struct.unpack_from("<HH", head, 26))


def index_rows(f, size: int):
    """(place of the record in the file, its length) from every index of a package."""
    found = members(f, size)
    begins = {name.rpartition("/")[2]: stored_at(f, m) for name, m in found.items() if name.startswith("archive/")}
    for name in sorted(found):
        if not name.startswith("indexes/"):
            continue
        raw = _at(f, stored_at(f, found[name]), found[name][1])
        if name.endswith(".gz"):
            raw = gzip.decompress(raw)
        for line in raw.decode("utf-8").split("\n"):
            if line:
                e = json.loads(line[line.index("{"):])
                yield begins[e["filename"]] + int(e["offset"]), int(e["length"])


# -- records ----------------------------------------------------------------

def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(page_id) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def _page(urn: str):
    x = urn[len("<urn:page:"):-1]
    return None if x == "null" else int(x)


def record(page_id, url, payload: bytes, size: int, sha: str, refers_to=None, revisit: bool = False) -> bytes:
    """One WARC record; a revisit has the headers of the response, not the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if revisit else http + payload
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else _urn(page_id)[1:-1]
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(page_id)}",
            f"WARC-Target-URI: {target}", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{sha}"]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_urn(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """Headers, HTTP headers and payload of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    h = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[:int(h["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    h["http"] = dict(x.split(": ", 1) for x in http.decode("utf-8").split("\r\n")[1:])
    h["payload"] = payload
    return h


# -- Spark ------------------------------------------------------------------

def decide(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """page_id, url, payload, payload_bytes, record_type, refers_to."""
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                     F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    p = p.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("__sha", F.sha1("payload"))
    last = materialize(p.groupBy("__sha", "payload_bytes").agg(F.max("page_id").alias("__last")), "warc-payloads")
    last = last.withColumnsRenamed({"__sha": "__s", "payload_bytes": "__n"})
    out = p.join(last, (F.col("__sha") == F.col("__s")) & (F.col("payload_bytes") == F.col("__n")))
    revisit = (F.col("payload_bytes") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("__last"))
    return out.select("page_id", "url", "payload", "payload_bytes",
                      F.when(revisit, "revisit").otherwise("response").alias("record_type"),
                      F.when(revisit, F.col("__last")).alias("refers_to"))


def write(records: DataFrame, folder: str | None = None, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Write packages; the manifest has a row (path, n_records) for each."""
    folder = folder or scratch_path(records.sparkSession, "warc")

    def run(batches):
        files, where = open_path(folder)
        data, index = io.BytesIO(), []

        def close():
            name = f"{uuid.uuid4().hex}.wacz"
            out = io.BytesIO()
            with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
                raw = data.getvalue()
                z.writestr(ARCHIVE, raw)
                z.writestr(INDEX, "\n".join(index))
                z.writestr("datapackage.json", json.dumps({"profile": "data-package", "resources": [
                    {"path": ARCHIVE, "bytes": len(raw), "hash": f"sha256:{hashlib.sha256(raw).hexdigest()}"}]}))
            files.create_dir(where, recursive=True)
            with files.open_output_stream(f"{where}/{name}") as f:
                f.write(out.getbuffer())
            n = len(index)
            data.seek(0)
            data.truncate()
            index.clear()
            return pd.DataFrame({"path": [f"{folder}/{name}"], "n_records": [n]})

        for b in batches:
            for r in b.itertuples(index=False):
                page = None if pd.isna(r.page_id) else int(r.page_id)
                to = None if pd.isna(r.refers_to) else int(r.refers_to)
                sha = digest(r.payload)
                raw = gzip.compress(record(page, r.url, r.payload, len(r.payload), sha, to, r.record_type == "revisit"),
                                    compresslevel=3, mtime=0)
                index.append(f"{_urn(page)[1:-1]} {DATE} " + json.dumps(
                    {"filename": ARCHIVE.rpartition("/")[2], "offset": str(data.tell()), "length": str(len(raw)), "digest": f"sha1:{sha}"}))
                data.write(raw)
                if data.tell() >= package_bytes:
                    yield close()
        if index:
            yield close()

    return materialize(records.mapInPandas(run, "path string, n_records long"), "warc-manifest")


def read_index(manifest: DataFrame) -> DataFrame:
    """path, offset, length of every record of the packages in ``path``."""
    def run(batches):
        for b in batches:
            for path in b["path"]:
                files, where = open_path(path)
                with files.open_input_file(where) as f:
                    rows = list(index_rows(f, f.size()))
                yield pd.DataFrame({"path": path, "offset": [x[0] for x in rows], "length": [x[1] for x in rows]})
    return manifest.select("path").mapInPandas(run, "path string, offset long, length long")


def read_records(index: DataFrame) -> DataFrame:
    """Range-read records: page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to.

    Size and digest of a response come from its payload, and a digest that differs
    from the header's is an error; those of a revisit come from its headers."""
    def run(batches):
        name, f = None, None
        for b in batches:
            rows = []
            for path, offset, length in b[["path", "offset", "length"]].itertuples(index=False):
                if path != name:
                    files, where = open_path(path)
                    name, f = path, files.open_input_file(where)
                h = parse(zlib.decompress(_at(f, offset, length), 31))
                sha = h["WARC-Payload-Digest"].removeprefix("sha1:")
                if h["WARC-Type"] == "response":
                    if digest(h["payload"]) != sha:
                        raise ValueError(f"damaged record at {offset} of {path}")
                    rows.append((_page(h["WARC-Record-ID"]), h["WARC-Target-URI"], h["payload"], len(h["payload"]), sha, "response", None))
                else:
                    rows.append((_page(h["WARC-Record-ID"]), h["WARC-Target-URI"], None, int(h["http"]["Content-Length"]), sha,
                                 h["WARC-Type"], _page(h["WARC-Refers-To"])))
            out = pd.DataFrame(rows, columns=["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"])
            out["page_id"], out["refers_to"] = out["page_id"].astype("Int64"), out["refers_to"].astype("Int64")
            yield out
    parts = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return index.repartitionByRange(parts, "path", "offset").sortWithinPartitions("path", "offset").mapInPandas(
        run, "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long")
