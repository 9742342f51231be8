"""WARC archives: one gzip member per record, revisits for repeated payloads, salvage reads."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import store

FILE_BYTES = 64 << 20
READ_BYTES = 1 << 20
PIECE_BYTES = 64 << 10
HEAD_BYTES = 64 << 20      # a header that is longer is taken for damage
GZIP = b"\x1f\x8b\x08"
VERSION = b"WARC/1."
HEAD_END = b"\r\n\r\n"
MANIFEST = "path string, n_records bigint, n_bytes bigint"
RECORD = ("path string, start bigint, end bigint, status string, reason string, "
          "record_id string, record_type string, uri string, refers_to string, "
          "payload_digest string, payload_bytes bigint, payload binary")


def with_revisits(records: DataFrame, least: int = 100) -> DataFrame:
    """Adds ``payload_digest``, ``payload_bytes``, ``record_type`` and ``refers_to``.

    ``records``: ``(record_id bigint, uri, payload)``; a null payload is empty. Among equal
    payloads of ``least`` bytes or more, the record with the smallest id is the response.
    Rows with that same id are responses too, null ids are never the smallest unless all
    are null. Only ids and digests are aggregated, per task first.
    """
    rows = records.select("record_id", "uri", F.coalesce("payload", F.lit("").cast("binary")).alias("payload"))
    rows = rows.select("*", F.sha2("payload", 256).alias("payload_digest"),
                       F.octet_length("payload").cast("bigint").alias("payload_bytes"))
    first = (rows.where(F.col("payload_bytes") >= least).groupBy("payload_digest")
             .agg(F.min("record_id").alias("first"), F.count("*").alias("copies"))
             .where("copies > 1 and first is not null").drop("copies"))
    again = (F.col("payload_bytes") >= least) & F.col("first").isNotNull() & ~F.col("record_id").eqNullSafe(F.col("first"))
    return (rows.join(first, "payload_digest", "left")
            .withColumn("record_type", F.when(again, "revisit").otherwise("response"))
            .withColumn("refers_to", F.when(again, F.col("first"))).drop("first"))


def _urn(record_id: int | None) -> str:
    return f"<urn:record:{'' if record_id is None else record_id}>"


def _line(value: str | None) -> str:
    return (value or "").replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def record_bytes(row: dict) -> bytes:
    """A record: header lines, an HTTP head, and the payload unless it is a revisit."""
    revisit = row["record_type"] == "revisit"
    http = ("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            f"Content-Length: {row['payload_bytes']}\r\n\r\n").encode()
    block = http if revisit else http + row["payload"]
    head = [f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: {_urn(row['record_id'])}",
            "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {_line(row['uri'])}",
            "Content-Type: application/http; msgtype=response",
            f"WARC-Payload-Digest: sha256:{row['payload_digest']}",
            f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}"]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 f"WARC-Refers-To: {_urn(row['refers_to'])}"]
    head.append(f"Content-Length: {len(block)}")
    return b"WARC/1.1\r\n" + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write(records: DataFrame, folder: store.Folder, compress: bool = True,
          file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes the records of ``with_revisits`` to archives; returns the manifest of files.

    A task writes files of about ``file_bytes`` under its attempt's own name; the manifest
    holds those of attempts that ended. An empty table gives an empty manifest.
    """
    target = folder.files("warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, inside = store.filesystem(target)
        fs.create_dir(inside, recursive=True)
        out = name = None
        n = size = files = 0

        def done() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pydict({"path": [name], "n_records": [n], "n_bytes": [size]})

        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    name = f"{target}/{store.attempt_name()}-{files:05d}.warc{'.gz' if compress else ''}"
                    out, n, size, files = fs.open_output_stream(store.filesystem(name)[1], compression=None), 0, 0, files + 1
                raw = record_bytes(row)
                if compress:
                    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
                    raw = pack.compress(raw) + pack.flush()
                out.write(raw)
                n, size = n + 1, size + len(raw)
                if size >= file_bytes:
                    yield done()
                    out = None
        if out is not None:
            yield done()

    names = ["record_id", "uri", "payload", "payload_digest", "payload_bytes", "record_type", "refers_to"]
    return folder.cut(records.select(*names).mapInArrow(run, MANIFEST), "warc-manifest")


class Damaged(Exception):
    pass


def _number(text: str) -> int | None:
    """A length in ASCII digits; None for anything else, however it came about."""
    return int(text) if re.fullmatch(r"[0-9]{1,18}", text, re.ASCII) else None


class Bytes:
    """Positions of a file, read in blocks; only the part in use is held."""

    def __init__(self, file, size: int):
        self.file, self.size, self.at, self.held = file, size, 0, b""

    def get(self, at: int, n: int) -> bytes:
        if at < self.at or at + n > self.at + len(self.held):
            self.at, self.held = at, self.file.read_at(max(n, READ_BYTES), at)
        return self.held[at - self.at:at - self.at + n]

    def piece(self, at: int) -> bytes:
        """Some bytes from ``at`` on, as many as are held, none at the end of the file."""
        if not self.at <= at < self.at + len(self.held):
            self.at, self.held = at, self.file.read_at(READ_BYTES, at)
        return self.held[at - self.at:at - self.at + PIECE_BYTES]

    def find(self, at: int) -> tuple[int, bool]:
        """Next place from ``at`` on where a member or a version line may begin."""
        while at < self.size:
            block = self.get(at, READ_BYTES)
            places = [(p, gz) for p, gz in ((block.find(GZIP), True), (block.find(VERSION), False)) if p >= 0]
            if places:
                p, gz = min(places)
                return at + p, gz
            at += max(1, len(block) - len(VERSION) + 1)
        return self.size, False


def _member(source: Bytes, at: int) -> tuple[bytes, int]:
    """The content of the gzip member at a position, and where it ends.

    Unpacking stops where the content shows no record header, or outgrows the length that
    its header gives, so a damaged member never takes more memory than a record may.
    """
    unpack, raw, whole = zlib.decompressobj(31), bytearray(), None
    try:
        while not unpack.eof:
            block = unpack.unconsumed_tail
            if not block:
                block = source.piece(at)
                at += len(block)
            part = unpack.decompress(block, READ_BYTES)
            if not (block or part or unpack.eof):
                raise Damaged("gzip member is cut off")
            raw += part
            if not VERSION.startswith(raw[:len(VERSION)]):
                raise Damaged("no version line")
            if whole is None and raw.find(HEAD_END, max(0, len(raw) - len(part) - 3)) >= 0:
                fields, start = _head(raw)
                whole = start + _number(fields["content-length"]) + 4
            if len(raw) > (HEAD_BYTES if whole is None else whole):
                raise Damaged("header does not end" if whole is None else "length does not fit")
    except zlib.error as e:
        raise Damaged(f"gzip: {str(e)[:60]}") from None
    return bytes(raw), at - len(unpack.unused_data)


def _head(raw: bytes | bytearray) -> tuple[dict[str, str], int]:
    """Header fields by lower-case name, and where the block begins."""
    end = raw.find(HEAD_END)
    if not raw.startswith(VERSION) or end < 0:
        raise Damaged("no header")
    fields = {}
    for line in raw[:end].decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise Damaged("header line without a colon")
        fields[name.strip().lower()] = value.strip()
    if _number(fields.get("content-length", "")) is None:
        raise Damaged("no content length")
    if not fields.get("warc-record-id") or not fields.get("warc-type"):
        raise Damaged("no record id or type")
    return fields, end + 4


def _plain(source: Bytes, at: int) -> tuple[bytes, int]:
    """The record that begins at a version line."""
    n = READ_BYTES
    while True:
        raw = source.get(at, min(n, source.size - at))
        if HEAD_END in raw or len(raw) < n or n > HEAD_BYTES:
            break
        n *= 2
    fields, start = _head(raw)
    whole = start + _number(fields["content-length"]) + 4
    if at + whole > source.size:
        raise Damaged("record is cut off")
    return source.get(at, whole), at + whole


def _checked(raw: bytes) -> dict:
    """Fields of a record whose length and digests hold."""
    fields, start = _head(raw)
    size = _number(fields["content-length"])
    block = raw[start:start + size]
    if len(raw) != start + size + 4 or raw[-4:] != HEAD_END:
        raise Damaged("length does not fit")
    wanted = fields.get("warc-block-digest", "")
    if wanted.startswith("sha256:") and wanted[7:] != hashlib.sha256(block).hexdigest():
        raise Damaged("block digest does not fit")
    http, _, payload = block.partition(b"\r\n\r\n")
    kind, digest = fields.get("warc-type"), fields.get("warc-payload-digest", "").removeprefix("sha256:")
    if kind == "revisit":
        sizes = [line[15:].strip() for line in http.decode("latin-1").split("\r\n")
                 if line.lower().startswith("content-length:")]
        n, payload = (_number(sizes[0]) if sizes else None), None
    else:
        found, n = hashlib.sha256(payload).hexdigest(), len(payload)
        if digest and digest != found:
            raise Damaged("payload digest does not fit")
        digest = found
    return {"record_id": fields.get("warc-record-id"), "record_type": kind,
            "uri": fields.get("warc-target-uri", "").replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%"),
            "refers_to": fields.get("warc-refers-to"), "payload_digest": digest,
            "payload_bytes": n, "payload": payload}


def salvage(file, size: int) -> Iterator[dict]:
    """Records and gaps of an archive, in the order of their bytes.

    A place that fails a check starts a gap. The gap ends at the next place where a whole
    member, or a record behind a version line, passes all checks; so later records are
    recovered, and every byte is either in a record or in a logged gap. No bytes make it
    fail: a length that is no plain number, or an endless header, is damage like any other.
    """
    source, at, gap, reason = Bytes(file, size), 0, None, None
    while at < size:
        try:
            if source.get(at, min(3, size - at)) == GZIP:
                raw, end = _member(source, at)
            elif source.get(at, min(len(VERSION), size - at)) == VERSION:
                raw, end = _plain(source, at)
            else:
                raise Damaged("neither a member nor a version line")
            row = _checked(raw)
        except Damaged as e:
            if gap is None:
                gap, reason = at, str(e)
            at, _ = source.find(at + 1)
            continue
        if gap is not None:
            yield {"start": gap, "end": at, "status": "gap", "reason": reason}
            gap = None
        yield {"start": at, "end": end, "status": "record", **row}
        at = end
    if gap is not None:
        yield {"start": gap, "end": size, "status": "gap", "reason": reason}


def read(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """All records and gaps (``status``) of the archives; a file is read by one task.

    Memory holds one record and a read block. ``payloads=False`` leaves payloads out of
    the result, after their digests were checked. Empty files have no rows.
    """
    names = [f.split()[0] for f in RECORD.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"start": pa.int64(), "end": pa.int64(), "payload_bytes": pa.int64(), "payload": pa.binary()}
        schema = pa.schema([(n, kinds.get(n, pa.string())) for n in names])

        def batch_of(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist(rows, schema)

        for batch in batches:
            for name in store.column(batch, "path").to_pylist():
                fs, inside = store.filesystem(name)
                with fs.open_input_file(inside) as file:
                    rows, held = [], 0
                    for row in salvage(file, file.size()):
                        held += len(row.get("payload") or b"")
                        if not payloads:
                            row["payload"] = None
                        rows.append({"path": name, **row})
                        if len(rows) == 1000 or held > store.TEXT_BYTES:
                            yield batch_of(rows)
                            rows, held = [], 0
                    if rows:
                        yield batch_of(rows)

    return store.spread(manifest.select("path")).mapInArrow(run, RECORD)
