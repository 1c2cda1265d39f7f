"""WARC archives as a PySpark data source, ``spark.read.format("warc")`` and ``df.write.format("warc")``.

Writing: each task writes one file of WARC/1.1 records, and hands its name to the
driver; the commit adds a manifest of those names.  A reader takes only what manifests
name, so a failed attempt's file is never read.  With ``compression`` gzip (the
default), each record is a gzip member whose header holds the WARC skip lengths ("sl"
extra field), so that a reader can pass over it without inflating it.

Reading: the driver lists the files and plans partitions of about ``partition_bytes``; files are not
opened there.  Filters on record type and other header columns are pushed down.  A
reader parses a record's headers first, checks the filters, and skips the payload of a
record that is not wanted: it is neither inflated further nor copied.  With
``payload`` false, no payload is read at all.  With ``verify`` true, a payload
that does not fit its digest raises.

Columns (one record a row): see SCHEMA.  A revisit carries the HTTP header of its response,
with the full length, and no payload.

Defined cases: header values are percent-encoded where they hold control characters; null fields
are left out; a null payload is an empty one; record ids may repeat; an empty folder or table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, WriterCommitMessage

SCHEMA = "record_id string, type string, target_uri string, date string, refers_to string, payload_digest string, payload_length long, payload binary"
_HEADERS = {"record_id": "WARC-Record-ID", "type": "WARC-Type", "target_uri": "WARC-Target-URI", "date": "WARC-Date", "refers_to": "WARC-Refers-To", "payload_digest": "WARC-Payload-Digest"}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "_manifest-"


def _filesystem(path: str):
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)


def _clean(value: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def _digest(sha1: bytes) -> str:
    return "sha1:" + base64.b32encode(sha1).decode()


def hex_digest(header: str) -> str:
    """``sha1:BASE32`` -> lower-case hex."""
    return base64.b32decode(header.removeprefix("sha1:")).hex()


def record(row: dict) -> bytes:
    """One record.  A revisit takes payload_digest and payload_length from the row; a response, from its payload."""
    payload = row.get("payload") or b""
    revisit = row["type"] == "revisit"
    digest = row.get("payload_digest") if revisit else _digest(hashlib.sha1(payload).digest())
    length = row.get("payload_length") if revisit else len(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length or 0}\r\n\r\n".encode()
    block = http if revisit else http + payload
    fields = {"WARC-Type": row["type"], "WARC-Record-ID": row.get("record_id") or f"<urn:uuid:{uuid.uuid4()}>", "WARC-Date": row.get("date") or "1970-01-01T00:00:00Z", "WARC-Target-URI": row.get("target_uri"), "WARC-Refers-To": row.get("refers_to") if revisit else None, "WARC-Profile": REVISIT_PROFILE if revisit else None, "WARC-Payload-Digest": digest, "Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v if k == 'Content-Type' else _clean(v)}\r\n" for k, v in fields.items() if v is not None) + "\r\n"
    return head.encode("utf-8", "replace") + block + b"\r\n\r\n"


def member(data: bytes, level: int) -> bytes:
    """A gzip member with the skip lengths of its compressed (whole member) and plain data."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    total = 12 + 12 + len(body) + 8
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H2sHII", 12, b"sl", 8, total, len(data) & 0xFFFFFFFF) + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


class _Written(WriterCommitMessage):
    def __init__(self, name: str | None, size: int):
        self.name, self.size = name, size


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.gzip, self.level, self.overwrite = options["path"].rstrip("/"), options.get("compression", "gzip") == "gzip", int(options.get("level", "1")), overwrite

    def write(self, batches):
        files, base = _filesystem(self.path)
        name, out, size = f"part-{uuid.uuid4().hex}.warc" + ".gz" * self.gzip, None, 0
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    files.create_dir(base, recursive=True)
                    out = files.open_output_stream(f"{base}/{name}", compression=None)
                data = record(row)
                data = member(data, self.level) if self.gzip else data
                out.write(data)
                size += len(data)
        if out is None:
            return _Written(None, 0)
        out.close()
        return _Written(name, size)

    def commit(self, messages):
        files, base = _filesystem(self.path)
        files.create_dir(base, recursive=True)
        if self.overwrite:
            for old in _manifests(files, base):
                files.delete_file(old)
        with files.open_output_stream(f"{base}/{MANIFEST}{uuid.uuid4().hex}.json") as out:
            out.write(json.dumps([[m.name, m.size] for m in messages if m and m.name]).encode())

    def abort(self, messages):
        files, base = _filesystem(self.path)
        for m in messages:
            if m and m.name:
                files.delete_file(f"{base}/{m.name}")


def _manifests(files, base: str) -> list[str]:
    from pyarrow import fs

    found = files.get_file_info(fs.FileSelector(base, allow_not_found=True))
    return sorted(i.path for i in found if i.base_name.startswith(MANIFEST))


class _Files(InputPartition):
    def __init__(self, names: list[str]):
        super().__init__(tuple(names))


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.bytes = options["path"].rstrip("/"), int(options.get("partition_bytes", str(16 << 20)))
        self.payload, self.verify = options.get("payload", "true").lower() == "true", options.get("verify", "false").lower() == "true"
        self.wanted: dict[str, list | None] = {}

    def pushFilters(self, filters: list[Filter]):
        """Equality, membership and presence on header columns are taken; what else there is goes back to Spark."""
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name in _HEADERS and isinstance(f, EqualTo | In):
                values = [f.value] if isinstance(f, EqualTo) else list(f.value)
                had = self.wanted.get(name)
                self.wanted[name] = values if had is None else [v for v in had if v in values]
            elif name in _HEADERS and isinstance(f, IsNotNull):
                self.wanted.setdefault(name, None)
            else:
                yield f

    def partitions(self):
        from pyarrow import fs

        files, base = _filesystem(self.path)
        named = []
        for manifest in _manifests(files, base):
            with files.open_input_stream(manifest) as f:
                named += json.loads(f.read())
        if not _manifests(files, base):  # archives of another tool
            found = files.get_file_info(fs.FileSelector(base, allow_not_found=True, recursive=True))
            named = [[i.path[len(base) + 1 :], i.size] for i in found if i.path.endswith((".warc", ".warc.gz"))]
        out, names, size = [], [], 0
        for name, n in sorted(named):
            if names and size + n > self.bytes:
                out.append(_Files(names))
                names, size = [], 0
            names.append(name)
            size += n
        return [*out, _Files(names)] if names or not out else out

    def read(self, partition):
        files, base = _filesystem(self.path)
        kind = pa.schema([("record_id", pa.string()), ("type", pa.string()), ("target_uri", pa.string()), ("date", pa.string()), ("refers_to", pa.string()), ("payload_digest", pa.string()), ("payload_length", pa.int64()), ("payload", pa.binary())])
        rows, size = [], 0
        for name in partition.value:
            with files.open_input_file(f"{base}/{name}") as f:
                for row in records(f, name.endswith(".gz"), self._keep, self.payload, self.verify):
                    rows.append(row)
                    size += len(row["payload"] or b"") + 500
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema=kind)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=kind)

    def _keep(self, head: dict[str, str]) -> bool:
        for name, values in self.wanted.items():
            got = head.get(_HEADERS[name].lower())
            if got is None or values is not None and got not in values:
                return False
        return True


class _Plain:
    """Buffered reads of a plain archive; ``skip`` seeks."""

    def __init__(self, f):
        self.f, self.buffer, self.end = f, b"", False

    def fill(self, n: int) -> bool:
        while len(self.buffer) < n and not self.end:
            got = self.f.read(max(1 << 16, n - len(self.buffer)))
            self.end = not got
            self.buffer += got
        return len(self.buffer) >= n

    def head(self) -> bytes | None:
        while b"\r\n\r\n" not in self.buffer:
            if not self.fill(len(self.buffer) + 1):
                return None
        head, _, self.buffer = self.buffer.partition(b"\r\n\r\n")
        return head

    def take(self, n: int) -> bytes:
        if not self.fill(n):
            raise ValueError("archive ends within a record")
        got, self.buffer = self.buffer[:n], self.buffer[n:]
        return got

    def skip(self, n: int) -> None:
        if n <= len(self.buffer):
            self.buffer = self.buffer[n:]
        else:
            self.f.seek(n - len(self.buffer), 1)
            self.buffer = b""

    def next(self) -> None:
        """To the start of the next record, past the two line ends."""
        self.skip(4)


class _Members:
    """The same over an archive of gzip members; passing over a member with skip lengths inflates nothing more."""

    def __init__(self, f):
        self.f, self.raw, self.plain, self.inflate, self.left = f, b"", b"", None, None

    def _more(self) -> bool:
        """Inflates up to 64 KiB more of the member; False at its end."""
        if self.inflate is None or self.inflate.eof:
            return False
        if not self.raw:
            self.raw = self.f.read(1 << 16)
            if not self.raw:
                raise ValueError("archive ends within a record")
        had = len(self.raw)
        self.plain += self.inflate.decompress(self.raw, 1 << 16)
        self.raw = self.inflate.unconsumed_tail or self.inflate.unused_data
        self.used += had - len(self.raw)
        return True

    def head(self) -> bytes | None:
        if not self.raw:
            self.raw = self.f.read(1 << 16)
        if not self.raw:
            return None
        while len(self.raw) < 24 and (got := self.f.read(1 << 16)):
            self.raw += got
        fixed = self.raw[:24]
        self.left = struct.unpack("<I", fixed[16:20])[0] if len(fixed) == 24 and fixed[3] & 4 and fixed[12:14] == b"sl" else None
        self.inflate, self.plain, self.used = zlib.decompressobj(31), b"", 0
        while b"\r\n\r\n" not in self.plain:
            if not self._more():
                return None
        head, _, self.plain = self.plain.partition(b"\r\n\r\n")
        return head

    def take(self, n: int) -> bytes:
        while len(self.plain) < n:
            if not self._more():
                raise ValueError("a record is shorter than its length says")
        got, self.plain = self.plain[:n], self.plain[n:]
        return got

    def skip(self, n: int) -> None:
        pass  # next() passes over the whole member

    def next(self) -> None:
        if self.left is None:
            while not self.inflate.eof:
                self.plain = b""
                self._more()
            return
        rest = self.left - self.used
        if rest <= len(self.raw):
            self.raw = self.raw[rest:]
        else:
            self.f.seek(rest - len(self.raw), 1)
            self.raw = b""


def _parse(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines) if k}


def records(f, gzip: bool, keep=lambda head: True, payload: bool = True, verify: bool = False):
    """The records of an open archive whose headers ``keep`` accepts, as dicts of SCHEMA's columns."""
    source = _Members(f) if gzip else _Plain(f)
    while (raw := source.head()) is not None:
        head = _parse(raw)
        n = int(head["content-length"])
        if not keep(head):
            source.skip(n)
            source.next()
            continue
        row = {name: head.get(key.lower()) for name, key in _HEADERS.items()} | {"payload": None, "payload_length": None}
        http = head.get("content-type", "").startswith("application/http")
        if payload or http and row["type"] == "revisit":
            block = source.take(n)
            body = block
            if http:
                first, _, body = block.partition(b"\r\n\r\n")
                length = _parse(first).get("content-length")
                row["payload_length"] = int(length) if length and length.isdigit() else len(body)
            else:
                row["payload_length"] = n
            if row["type"] != "revisit" and payload:
                row["payload"] = body
                if verify and (row["payload_digest"] or "").startswith("sha1:") and _digest(hashlib.sha1(body).digest()) != row["payload_digest"]:
                    raise ValueError(f"payload of {row['record_id']} does not fit its digest")
        else:
            source.skip(n)
        yield row
        source.next()


class WarcDataSource(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite):
        return WarcWriter(dict(self.options), overwrite)


def register(spark) -> None:
    """Makes format("warc") known, with filter pushdown to Python data sources on."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)
