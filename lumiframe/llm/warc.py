"""WARC archives: a writer of gzip members with revisit records, and a reader that salvages what is behind damage."""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumiframe.llm.common import bounded_batches, materialize
from lumiframe.llm.files import Output, listing, open_store

#: Bytes of an archive at about which the next begins, of one read, and zlib's level.
FILE_BYTES, READ_BYTES, LEVEL = 64 << 20, 1 << 18, 5
DATE = "2020-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
GZIP, VERSION = b"\x1f\x8b\x08", b"WARC/1."
LINE_ENDS = re.compile(rb"[\r\n]*")
VERSION_LINE = re.compile(rb"WARC/1\.\d\r\n")

RECORD = T.StructType(
    [
        T.StructField("file", T.StringType()),
        T.StructField("offset", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("kind", T.StringType()),
        T.StructField("record_id", T.StringType()),
        T.StructField("refers_to", T.StringType()),
        T.StructField("uri", T.StringType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload", T.BinaryType()),
        T.StructField("problem", T.StringType()),
    ]
)


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(record_id: str, uri: str, payload: bytes, refers_to: str | None) -> bytes:
    """One record as a gzip member. A revisit has the HTTP head, with the full payload's length, and no payload."""
    digest = base32_sha1(payload)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    coder = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return coder.compress("\r\n".join(head).encode() + block + b"\r\n\r\n") + coder.flush()


def plan(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", least: int = 0) -> DataFrame:
    """page_id, url, payload, refers_to of every row: the smallest key with an equal payload, null where that is its own.

    Payloads under `least` bytes, and rows whose key is null, are never revisits. A null html is an empty payload.
    Repeated rows of the smallest key are responses all. Keys are numbers or text of whole numbers; other text raises.
    """
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).cast("binary").alias("payload")).withColumn("sha", F.sha1("payload"))
    # written out, so that Spark can split the join's partition of a payload that very many pages share
    first = materialize(rows.where(F.octet_length("payload") >= least).groupBy("sha").agg(F.min("page_id").alias("first_id")), "first-pages").withColumnRenamed("sha", "f_sha")
    joined = rows.join(first, rows["sha"] == first["f_sha"], "left")
    return joined.select("page_id", "url", "payload", F.when(F.col("page_id") != F.col("first_id"), F.col("first_id")).alias("refers_to"))


def write(planned: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write the records of plan() to archives of a folder; returns file, records, bytes of each.

    Every attempt of a task has names of its own, and the returned table lists the files of those that were committed:
    give it to read(), and files of lost or repeated attempts don't count, in whatever order these had their rows.
    A null url is empty, line ends in one become %0A, and an empty table writes no file.
    """
    bounded_batches(planned.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, k, out, n = TaskContext.get(), 0, None, 0
        name = lambda: f"part-{task.partitionId():05d}-{task.taskAttemptId()}-{k:04d}.warc.gz"

        def done():
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([name()]), pa.array([n], pa.int64()), pa.array([out.size], pa.int64())], names=["file", "records", "bytes"])

        try:
            for b in batches:
                for page, url, payload, refers in zip(*[c.to_pylist() for c in b.columns], strict=True):
                    if out is None:
                        out, n = Output(folder, name()), 0
                    uri = re.sub(r"[\r\n]+", "%0A", url or "")
                    out.write(record("urn:page:" + ("" if page is None else str(page)), uri, payload or b"", None if refers is None else f"urn:page:{refers}"))
                    n += 1
                    if out.size >= file_bytes:
                        yield done()
                        k, out = k + 1, None
            if out is not None:
                yield done()
                out = None
        finally:
            if out is not None:
                out.abort()

    return materialize(planned.select("page_id", "url", "payload", "refers_to").mapInArrow(run, "file string, records long, bytes long"), "warc-files")


class Damaged(ValueError):
    pass


class Salvage:
    """Records and gaps of an archive, plain or in gzip members, read through `read_at(size, offset)`.

    A member or record that fails a check (gzip's crc, version line, header, length, digests) is passed over: the next
    gzip member that begins with a version line, or the next version line that begins a sound record, is looked for
    from the byte after the failed one's first. The bytes between are one gap. A member may hold many records: once its
    crc is right, a record in it that fails a check is passed over in the same way, and every record and gap of it has the
    member's offset and length. Headers may be of any length. Memory: one plain record or unpacked member, and READ_BYTES.
    """

    def __init__(self, read_at, size: int):
        self.read_at, self.size = read_at, size

    def __iter__(self) -> Iterator[dict]:
        at = 0
        gap, why = None, ""
        while at < self.size:
            try:
                recs, end = self._one(at)
            except (Damaged, zlib.error, UnicodeError, ValueError) as e:
                if gap is None:
                    gap, why = at, f"{type(e).__name__}: {e}"
                at = self._next(at + 1)
                continue
            if gap is not None:
                yield {"offset": gap, "length": at - gap, "kind": "gap", "problem": why}
                gap = None
            for rec in recs:
                yield {"offset": at, "length": end - at} | rec
            at = end
        if gap is not None:
            yield {"offset": gap, "length": self.size - gap, "kind": "gap", "problem": why}

    def _one(self, at: int) -> tuple[Iterable[dict], int]:
        start = self.read_at(7, at)
        if start[:3] == GZIP:
            data, end = self._member(at)
            found = self._inside(data)
            first = next(found, None)
            before = [first] if first and first["kind"] == "gap" else []
            if before:
                first = next(found, None)
            if first is None:
                raise Damaged(before[0]["problem"] if before else "an empty member")
            return chain(before, [first], found), end
        if start == VERSION:
            rec, end = self._plain(at)
            return [rec], end
        raise Damaged("neither a gzip member nor a version line")

    def _inside(self, data: bytes) -> Iterator[dict]:
        """Records of an unpacked member, and a gap for each stretch between them that fails a check."""
        at, gap, why = 0, None, ""
        while at < len(data):
            try:
                if data[at : at + 7] != VERSION:
                    raise Damaged("a member without a version line" if at == 0 else "no version line after a record")
                rec, used = parse(data, at)
                end = LINE_ENDS.match(data, used).end()
                if end < len(data) and data[used : used + 4] != b"\r\n\r\n":
                    raise Damaged("no record end where the length says")
            except ValueError as e:
                if gap is None:
                    gap, why = at, str(e)
                at = data.find(b"WARC/1.", at + 1)
                at = len(data) if at < 0 else at
                continue
            if gap is not None:
                yield {"kind": "gap", "problem": f"bytes {gap} to {at} of a member: {why}"}
                gap = None
            yield rec
            at = end
        if gap is not None:
            yield {"kind": "gap", "problem": f"bytes {gap} to {at} of a member: {why}"}

    def _member(self, at: int) -> tuple[bytes, int]:
        d, parts, fed = zlib.decompressobj(31), [], at
        while not d.eof:
            chunk = self.read_at(READ_BYTES, fed)
            if not chunk:
                raise Damaged("a member ends early")
            parts.append(d.decompress(chunk))
            fed += len(chunk)
        return b"".join(parts), fed - len(d.unused_data)

    def _plain(self, at: int) -> tuple[dict, int]:
        data = bytearray(self.read_at(READ_BYTES, at))
        if not VERSION_LINE.match(data):
            raise Damaged("no version line")
        looked = 0
        while (i := data.find(b"\r\n\r\n", looked)) < 0:
            # a header may be of any length
            more = self.read_at(max(READ_BYTES, len(data)), at + len(data))
            if not more:
                raise Damaged("a header without an end")
            looked = max(0, len(data) - 3)
            data += more
        data = bytes(data)
        need = i + 4 + length_of(headers(data[:i])) + 4
        if at + need > self.size:
            raise Damaged("a record ends early")
        if len(data) < need:
            data += self.read_at(need - len(data), at + len(data))
        rec, used = parse(data[:need])
        if data[used : used + 4] != b"\r\n\r\n":
            raise Damaged("no record end where the length says")
        return rec, at + used + 4

    def _next(self, at: int) -> int:
        """The next place that may begin a sound record, or the end."""
        while at < self.size:
            data = self.read_at(READ_BYTES + 8, at)
            found = [m.start() for m in re.finditer(rb"\x1f\x8b\x08|WARC/1\.", data) if m.start() < READ_BYTES]
            for i in found:
                if data[i : i + 3] != GZIP or self._begins(at + i):
                    return at + i
            at += READ_BYTES
        return self.size

    def _begins(self, at: int) -> bool:
        try:
            return zlib.decompressobj(31).decompress(self.read_at(512, at), 16)[:7] == VERSION
        except zlib.error:
            return False


def headers(data: bytes) -> dict[str, str]:
    lines = data.decode("utf-8").split("\r\n")
    if not re.fullmatch(r"WARC/1\.\d", lines[0]):
        raise Damaged("no version line")
    out = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise Damaged("a header line without a colon")
        out[name.strip().lower()] = value.strip()
    return out


def length_of(h: dict[str, str]) -> int:
    if not re.fullmatch(r"\d{1,15}", h.get("content-length", "")):
        raise Damaged("no length")
    return int(h["content-length"])


def parse(data: bytes, at: int = 0) -> tuple[dict, int]:
    """The record that begins at a place of data, and the place where it ends without the end mark; Damaged if a check fails."""
    i = data.find(b"\r\n\r\n", at) if VERSION_LINE.match(data, at) else -1
    if i < 0:
        raise Damaged("a header without an end")
    h = headers(data[at:i])
    n = length_of(h)
    block = data[i + 4 : i + 4 + n]
    if len(block) < n:
        raise Damaged("a record ends early")
    if (d := h.get("warc-block-digest", "")).startswith("sha1:") and d[5:] != base32_sha1(block):
        raise Damaged("the block's digest differs")
    kind = h.get("warc-type", "")
    payload, size, digest = block, n, h.get("warc-payload-digest", "").removeprefix("sha1:") or None
    if h.get("content-type", "").startswith("application/http"):
        head, end, payload = block.partition(b"\r\n\r\n")
        if not end:
            raise Damaged("an HTTP block without a head")
        size = len(payload)
        if kind == "revisit":
            m = re.search(rb"(?im)^content-length:\s*(\d+)", head)
            size = int(m[1]) if m else None
    if kind == "response":
        if digest is not None and digest != base32_sha1(payload):
            raise Damaged("the payload's digest differs")
        digest = base32_sha1(payload)
    strip = lambda x: x.strip("<>") if x else None
    return {"kind": kind, "record_id": strip(h.get("warc-record-id")), "refers_to": strip(h.get("warc-refers-to")), "uri": h.get("warc-target-uri"), "payload_digest": digest, "payload_bytes": size, "payload": payload if kind != "revisit" else None}, i + 4 + n


def read(spark: SparkSession, folder: str, payloads: bool = True, files: DataFrame | None = None) -> DataFrame:
    """Records of the archives of a folder, and a row of kind `gap` with the reason for each stretch of bytes that was passed over.

    files: a table whose column `file` names the archives to read, all of the folder's if there is none. Without
    `payloads` that column is null, after its checks. Folders without archives give no row.
    """
    found = listing(folder, ".warc.gz") + listing(folder, ".warc")
    names = [f.name for f in RECORD.fields]
    table = spark.createDataFrame(found, "name string, size long")
    if files is not None:
        table = table.join(files.select(F.col("file").alias("name")), "name", "left_semi")
    table = table.repartition(max(1, min(len(found), 4 * spark.sparkContext.defaultParallelism)), "name")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(RECORD)
        store, path = open_store(folder)
        for b in batches:
            for file, size in zip(*[c.to_pylist() for c in b.columns], strict=True):
                with store.open_input_file(f"{path}/{file}") as f:
                    rows, held = [], 0
                    for r in Salvage(f.read_at, size):
                        if not payloads:
                            r["payload"] = None
                        rows.append({n: r.get(n) for n in names} | {"file": file})
                        held += len(r.get("payload") or b"") + 400
                        if held > 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema)

    return table.mapInArrow(run, RECORD)
