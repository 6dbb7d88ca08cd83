"""WARC archives: a writer with one gzip member per record, and a reader that splits large files.

A reading task gets a byte range and owns the records whose member starts inside.  It looks for
the gzip magic, and a candidate counts only if what it decodes to starts with a WARC header.  The
bytes of a stored archive inside a payload could pass that test too, so ranges are first walked
and compared: a range's first record must start where the record before it ends.  Ranges for
which that is not so are walked again from the proven place.

Files are read and written through ``pyarrow.fs`` by the URI of a shared folder.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from gradeloom.llm.common import shared_folder, staged

MAGIC = b"\x1f\x8b\x08"
#: Bytes of a split, of an archive before the writer starts the next, of one read and of one step of decoding.
SPLIT, ROTATE, READ, FEED = 32 << 20, 512 << 20, 1 << 20, 1 << 14
#: Bytes that are decoded at first to see a record header; longer ones are decoded further.
HEADER = 1 << 16
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS = "path string, offset long, page_id long, record_type string, target_uri string, payload_bytes long, payload_digest string, refers_to long, payload binary, error string"


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str = DATE) -> bytes:
    """One record as a gzip member; a revisit holds the HTTP head alone."""
    digest = base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = {"WARC-Type": "revisit" if revisit else "response", "WARC-Record-ID": record_id(page_id, digest), "WARC-Date": date,
            "WARC-Target-URI": quote(url, safe="".join(map(chr, range(33, 127)))) if url else "urn:unknown", "WARC-Payload-Digest": f"sha1:{digest}"}
    if page_id is not None:
        head["Page-Id"] = page_id
    if revisit:
        head |= {"WARC-Profile": PROFILE}
        if refers_to is not None:
            head |= {"WARC-Refers-To": record_id(refers_to, digest), "Refers-To-Page-Id": refers_to}
    else:
        block += payload
    head |= {"Content-Type": "application/http; msgtype=response", "Content-Length": len(block)}
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(text.encode() + block + b"\r\n\r\n") + packer.flush()


def _write(folder: str, rotate: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        part, out, size, n, path = TaskContext.get().partitionId(), None, 0, 0, ""
        done = []
        for batch in batches:
            for page_id, url, payload, refers_to, revisit in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if out is None:
                    path = f"part-{part:05d}-{uuid.uuid4().hex}.warc.gz"  # another attempt writes files of its own
                    out, size, n = store.open_output_stream(f"{base}/{path}", compression=None), 0, 0
                data = record(page_id, url, payload, refers_to, revisit)
                out.write(data)
                size, n = size + len(data), n + 1
                if size >= rotate:
                    out.close()
                    done.append((path, size, n))
                    out = None
        if out is not None:
            out.close()
            done.append((path, size, n))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{d[0]}" for d in done]), pa.array([d[1] for d in done]), pa.array([d[2] for d in done])], ["path", "size", "n_records"])

    return task


def first_pages(pages: DataFrame, page_id: str = "page_id", html: str = "html", min_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, refers_to, revisit: which pages repeat the payload of a page with a smaller id.

    NULL html is an empty payload.  Of equal payloads of at least ``min_bytes`` the one with the
    smallest page_id is the response; a NULL id comes after all others.  Repeated rows of the
    smallest id are responses all, and pages without any id are responses too.
    """
    payload = F.encode(F.coalesce(html, F.lit("")), "utf-8")
    url = F.col("url") if "url" in pages.columns else F.lit(None).cast("string")
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), url.alias("url"), payload.alias("payload"), F.unhex(F.sha2(payload, 256)).alias("digest"))
    firsts = staged(rows.groupBy("digest").agg(F.min("page_id").alias("first")), "first_pages").withColumnRenamed("digest", "first_digest")
    again = (F.octet_length("payload") >= min_bytes) & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    joined = rows.join(firsts, F.col("digest") == F.col("first_digest"))
    return joined.select("page_id", "url", "payload", F.when(again, F.col("first")).alias("refers_to"), again.alias("revisit"))


def write(pages: DataFrame, folder: str | None = None, page_id: str = "page_id", html: str = "html", min_bytes: int = 0, rotate: int = ROTATE) -> DataFrame:
    """Write a record for each page below ``folder``; returns path, size, n_records of the archives that count.

    Only listed archives belong to the result: a lost or repeated task leaves files that no row names.
    """
    folder = folder or shared_folder(pages.sparkSession, "warc")
    store, base = fs.FileSystem.from_uri(folder)
    store.create_dir(base)
    rows = first_pages(pages, page_id, html, min_bytes)
    return staged(rows.mapInArrow(_write(folder, rotate), "path string, size long, n_records long"), "archives")


class Buffer:
    """Bytes of a file from the position ``at`` on, read as they are asked for."""

    def __init__(self, file, at: int):
        self.file, self.at, self.data, self.pos = file, at, b"", 0
        file.seek(at)

    def more(self) -> bool:
        part = self.file.read(READ)
        self.data, self.pos = self.data[self.pos:] + part, 0
        return bool(part)

    def size(self) -> int:
        return len(self.data) - self.pos

    def part(self, begin: int, end: int) -> bytes:
        return self.data[self.pos + begin:self.pos + end]

    def drop(self, n: int) -> None:
        self.pos, self.at = self.pos + n, self.at + n


def member(window: Buffer, limit: int | None = None) -> tuple[bytes, int] | None:
    """What the gzip member at the window's start holds and its length in the file; None if it is none.

    With ``limit``, only that many decoded bytes, and 0 for the length.
    """
    unpack, out, fed = zlib.decompressobj(31), [], 0
    try:
        while not unpack.eof:
            if fed == window.size() and not window.more():
                return None
            part = window.part(fed, fed + FEED)
            fed += len(part)
            out.append(unpack.decompress(part, limit or 0))
            if limit and (sum(map(len, out)) >= limit or unpack.unconsumed_tail):
                return b"".join(out), 0
    except zlib.error:
        return None
    return b"".join(out), fed - len(unpack.unused_data)


def head_of(data: bytes) -> dict[str, str] | None:
    """The named fields of a record's header, names in lower case."""
    end = data.find(b"\r\n\r\n")
    if not data.startswith(b"WARC/") or end < 0:
        return None
    lines = [x.partition(":") for x in data[:end].decode("utf-8", "replace").split("\r\n")[1:]]
    head = {k.strip().lower(): v.strip() for k, _, v in lines} | {"": str(end + 4)}
    return head if head.get("content-length", "").isdigit() else None


def is_member(window: Buffer) -> bool:
    while window.size() < len(MAGIC) and window.more():
        pass
    if window.part(0, len(MAGIC)) != MAGIC:
        return False
    limit = HEADER
    while (found := member(window, limit)) is not None:
        if not found[0].startswith(b"WARC/"):
            return False
        if b"\r\n\r\n" in found[0] or found[1]:
            return head_of(found[0]) is not None
        limit *= 4
    return False


def seek_member(window: Buffer, end: int) -> bool:
    """Move to the first valid member that starts before ``end``."""
    while window.at < end:
        found = window.data.find(MAGIC, window.pos)
        if found < 0:
            window.drop(max(0, window.size() - len(MAGIC) + 1))
            if not window.more():
                return False
            continue
        window.drop(found - window.pos)
        if window.at < end and is_member(window):
            return True
        window.drop(1)
    return False


def members(file, start: int, end: int, proven: bool) -> Iterator[tuple[int, int, bytes | None]]:
    """Offset, end and content of the members that start in a range; content None: unreadable up to the end given."""
    window = Buffer(file, start)
    known = proven
    while window.at < end:
        if not known and not seek_member(window, end):
            if proven:
                yield start, end, None
            return
        found = member(window) if (window.size() or window.more()) else None
        if found is None:
            if not window.size():
                return
            at = window.at
            window.drop(1)
            known = seek_member(window, end)
            yield at, min(window.at, end), None
            if not known:
                return
            continue
        at = window.at
        window.drop(found[1])
        yield at, window.at, found[0]
        known = True


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """First member and end of the last one of each range."""
    for batch in batches:
        rows = []
        for x in batch.to_pylist():
            store, name = fs.FileSystem.from_uri(x["path"])
            first = last = None
            with store.open_input_file(name) as file:
                for at, after, _ in members(file, x["begin"], x["end"], x["proven"]):
                    first, last = at if first is None else first, after
            rows.append((x["path"], x["number"], x["start"], x["end"], first, last))
        if rows:
            types = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["path", "number", "start", "end", "first", "last"])


def ranges(archives: DataFrame, split: int = SPLIT) -> DataFrame:
    """path, number, start, end and begin of the byte ranges of archives (path, size), each with the place where its first record starts."""
    cut = archives.where("size > 0").select("path", "size", F.posexplode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(split).cast("long"))).alias("number", "start"))
    todo = staged(cut.select("path", "number", "start", F.least(F.col("start") + split, "size").alias("end"), F.col("start").alias("begin"), (F.col("number") == 0).alias("proven")), "ranges")
    schema = "path string, number int, start long, end long, first long, last long"
    walked = staged(spread(todo).mapInArrow(_walk, schema), "walked")
    while True:
        order = Window.partitionBy("path").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
        upto = walked.withColumn("proven_at", F.coalesce(F.max("last").over(order), F.lit(0)))  # where the records before it end
        wrong = F.col("number") > 0
        inside = F.col("proven_at") < F.col("end")
        wrong = wrong & ((inside & ~F.col("first").eqNullSafe(F.greatest("proven_at", "start"))) | (~inside & F.col("first").isNotNull()))
        marked = staged(upto.withColumn("wrong", wrong), "marked")
        if marked.where("wrong").isEmpty():
            break
        firsts = marked.where("wrong").groupBy("path").agg(F.min("number").alias("from"))  # all before are proven
        again = marked.join(firsts, "path", "left").withColumn("redo", F.coalesce(F.col("number") == F.col("from"), F.lit(False)))
        redo = again.where("redo").select("path", "number", "start", "end", F.greatest("proven_at", "start").alias("begin"), F.lit(True).alias("proven"))
        walked = staged(again.where("not redo").select("path", "number", "start", "end", "first", "last")
                        .unionByName(spread(redo).mapInArrow(_walk, schema)), "walked")
    return staged(marked.where("first is not null").select("path", "number", "start", "end", F.col("first").alias("begin")), "proven")


#: Tasks that ranges are dealt over at most.
TASKS = 20_000


def spread(rows: DataFrame) -> DataFrame:
    """One range after another over as many tasks as there are ranges, TASKS at most; with a number, so that small rows are not joined into one task."""
    return rows.repartition(min(max(rows.count(), 1), TASKS), "path", "number")


def _parse(path: str, offset: int, content: bytes, payloads: bool) -> Iterator[tuple]:
    """A row for each record of a member."""
    at = 0
    while at < len(content):
        blank = content.find(b"\r\n\r\n", at)
        head = head_of(content[at:blank + 4]) if blank >= 0 else None
        if head is None:
            yield (path, offset, None, None, None, None, None, None, None, "no WARC header")
            return
        body = at + int(head[""])
        block = content[body:body + int(head["content-length"])]
        at = body + len(block) + 4
        http, _, payload = block.partition(b"\r\n\r\n")
        kind = head.get("warc-type")
        whole = "msgtype=response" in head.get("content-type", "")
        payload = payload if whole else block
        digest, size, error = head.get("warc-payload-digest", "").removeprefix("sha1:") or None, len(payload), None
        if kind == "revisit":
            size = next((int(v) for k, _, v in (x.partition(b":") for x in http.split(b"\r\n")) if k.strip().lower() == b"content-length"), None)
        else:
            own = base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()
            error = "payload digest differs" if digest and digest != own else None
            digest = own
        number = lambda name: int(head[name]) if name in head else None
        yield (path, offset, number("page-id"), kind, head.get("warc-target-uri"), size, digest, number("refers-to-page-id"), payload if payloads else None, error)


def _read(payloads: bool):
    types = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.string())
    names = [x.split()[0] for x in RECORDS.split(", ")]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        size = 0
        pack = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
        for batch in batches:
            for x in batch.to_pylist():
                store, name = fs.FileSystem.from_uri(x["path"])
                with store.open_input_file(name) as file:
                    for at, _, content in members(file, x["begin"], x["end"], True):
                        rows = [(x["path"], at, *[None] * 7, "unreadable")] if content is None else _parse(x["path"], at, content, payloads)
                        for row in rows:
                            out.append(row)
                            size += len(row[8] or b"") + 200
                            if size >= 8 << 20:
                                yield pack()
                                out, size = [], 0
        if out:
            yield pack()

    return task


def read(archives: DataFrame, split: int = SPLIT, payloads: bool = True) -> DataFrame:
    """All records of archives (path, size): path, offset, page_id, record_type, target_uri, payload_bytes, payload_digest, refers_to, payload, error.

    payload_bytes and payload_digest (SHA-1, base 32) are of the full payload: a revisit's come
    from its HTTP head and its digest field.  Bytes that cannot be read give one row with an
    error for each gap, and a payload that contradicts its digest is reported, not dropped.
    Empty archives and an empty list give no rows.
    """
    return spread(ranges(archives, split)).mapInArrow(_read(payloads), RECORDS)


def archives_in(spark: SparkSession, folder: str) -> DataFrame:
    """path and size of the ``.warc.gz`` files of a folder, by Spark's own listing."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", F.col("length").alias("size"))
