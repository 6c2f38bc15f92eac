"""WARC archives: a writer with revisit records, and a reader that salvages what damage leaves.

Archives hold one gzip member per record. The reader checks every member (its checksum), its version line, its headers
and its block length and payload digest. After a failed check it searches for the next place where a member with a
valid version line begins (in an uncompressed archive: the next version line), goes on there and logs the bytes
between as quarantined.

Archives are written to the shared folder under a name of the task's attempt and renamed when complete; the table of
names that the query goes on with holds committed attempts only, so a lost executor leaves at most stray files.

Defined cases: a null payload is empty; payloads below ``least`` bytes are always responses; of equal larger payloads the
largest id is the response (ids null sort first; several rows with that id are all responses); repeated rows
are written once each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pelagia.llm.shared import bounded, materialise, shared_dir, table

LEAST, VOLUME, READ = 1000, 32 << 20, 1 << 20
#: Bytes of a record's block and of its headers at most, for the reader.
LARGEST, HEADERS = 1 << 31, 1 << 16
VERSION = b"WARC/1.1"
_VERSION_LINE = re.compile(rb"WARC/1\.[01]\r?\n")
_MAGIC = b"\x1f\x8b\x08"


class Damaged(Exception):
    """A record fails a check."""


class Short(Damaged):
    """The bytes at hand end before the record does; ``need`` would do."""

    def __init__(self, what: str, need: int) -> None:
        super().__init__(what)
        self.need = need


def record(headers: dict[str, str], block: bytes) -> bytes:
    lines = [VERSION, *(f"{k}: {v}".encode() for k, v in headers.items()), b"Content-Length: %d" % len(block)]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 1) -> bytes:
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def parse(data: bytes) -> tuple[dict[str, str], bytes, int]:
    """Headers, block and length of the record that data begins with. Raises Damaged; Short if more data may help."""
    if not (m := _VERSION_LINE.match(data)):
        raise Damaged("no version line")
    end = data.find(b"\r\n\r\n", m.end() - 2, HEADERS)
    if end < 0:
        if len(data) < HEADERS:
            raise Short("headers do not end", HEADERS)
        raise Damaged("headers do not end")
    headers = {}
    for line in data[m.end() : end].split(b"\r\n") if end > m.end() else []:
        k, colon, v = line.partition(b":")
        if not colon:
            raise Damaged("malformed header")
        headers[k.decode("utf-8", "replace").strip().lower()] = v.decode("utf-8", "replace").strip()
    n = headers.get("content-length", "")
    if not (n.isascii() and n.isdigit()) or len(n) > 15:
        raise Damaged("no length")
    start, stop = end + 4, end + 4 + int(n)
    if len(data) < stop + 4:
        raise Short("block is cut short", stop + 4)
    block = data[start:stop]
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise Damaged("record does not end where its length says")
    want = headers.get("warc-payload-digest", "")
    if headers.get("warc-type") != "revisit" and want.startswith("sha1:") and want[5:] != hashlib.sha1(block).hexdigest():
        raise Damaged("payload digest differs")
    return headers, block, stop + 4


class _Source:
    """A window on a byte stream, so that an archive is never held as a whole: ``data`` begins ``at`` bytes into it, and the
    bytes before ``lo`` are done with."""

    def __init__(self, stream) -> None:
        self.stream, self.at, self.data, self.lo, self.over = stream, 0, b"", 0, False

    def need(self, n: int) -> memoryview:
        """The window from ``lo`` on, of at least n bytes unless the stream ends."""
        if len(self.data) - self.lo < n and not self.over:
            parts, have = [self.data[self.lo :]], len(self.data) - self.lo
            self.at, self.lo = self.at + self.lo, 0
            while have < n and not self.over:
                got = self.stream.read(max(READ, n - have))
                self.over = not got
                parts.append(got)
                have += len(got)
            self.data = b"".join(parts)
        return memoryview(self.data)[self.lo :]

    @property
    def place(self) -> int:
        return self.at + self.lo

    def skip(self, n: int) -> None:
        self.lo += n

    def find(self, what: bytes | re.Pattern, begin: int) -> int:
        """Where it next stands in the window, ``begin`` bytes on or later; -1 if nowhere."""
        i = self.data.find(what, self.lo + begin) if isinstance(what, bytes) else (m.start() if (m := what.search(self.data, self.lo + begin)) else -1)
        return i - self.lo if i >= 0 else -1


def _member(src: _Source, largest: int) -> tuple[bytes, int]:
    """The unpacked member at the source's place, and its packed length."""
    d, out, used, n = zlib.decompressobj(31), [], 0, 0
    try:
        while not d.eof:
            part = src.need(used + 1)[used : used + READ]
            if not part:
                raise Damaged("member is cut short")
            out.append(d.decompress(part))
            n += len(out[-1])
            if n > largest + HEADERS:
                raise Damaged("longer than a record may be")
            used += len(part)
        used -= len(d.unused_data)
    except zlib.error as e:
        raise Damaged(str(e)) from None
    return b"".join(out), used


def _plain(src: _Source, largest: int) -> tuple[dict[str, str], bytes, int]:
    """The uncompressed record at the source's place: its headers, then as much as they announce. Only what ends too early
    is read again with more; every other fault is final."""
    n = 4096
    while True:
        data = src.need(n)
        try:
            return parse(bytes(data[:n]))
        except Short as e:
            if e.need > largest + HEADERS:
                raise Damaged("longer than a record may be") from None
            if src.over and len(data) <= n:
                raise
            n = max(e.need, n + 1)


def _begins(src: _Source, i: int) -> bool:
    """A member begins i bytes on, and its first bytes are a version line."""
    try:
        return bool(_VERSION_LINE.match(zlib.decompressobj(31).decompress(src.need(i + 4096)[i : i + 4096], 64)))
    except zlib.error:
        return False


def _next(src: _Source) -> None:
    """Go to the next place after this one where a record can begin, or to the end."""
    step = 1
    while True:
        src.need(step + READ)
        places = [i for i in (src.find(_MAGIC, step), src.find(_VERSION_LINE, step)) if i >= 0]
        if places:
            i = min(places)
            if src.data[src.lo + i : src.lo + i + 1] == b"W" or _begins(src, i):
                return src.skip(i)
            step = i + 1
            if step > READ:  # what has been searched need not be held
                src.skip(step - 1)
                step = 1
            continue
        there = len(src.data) - src.lo
        if src.over:
            return src.skip(there)
        src.skip(max(0, there - 16))  # a line or a magic may stand across the window's end
        step = 1 if there <= 16 else 0


def read(stream, largest: int = LARGEST) -> Iterator[tuple[str, int, int, object]]:
    """("record", begin, end, (headers, block)) and ("gap", begin, end, reason), in order. What is held at once is a record
    of at most ``largest`` bytes and a few reads; longer ones are gaps."""
    src, reason, gap = _Source(stream), "", None
    while len(head := src.need(3)):
        try:
            if bytes(head[:3]) == _MAGIC or head[0] == 0x1F:
                data, used = _member(src, largest)
                headers, block, length = parse(data)
                if length != len(data):
                    raise Damaged("bytes after the record")
            else:
                headers, block, used = _plain(src, largest)
        except Damaged as e:
            if gap is None:
                gap, reason = src.place, str(e)
            _next(src)
            continue
        if gap is not None:
            yield "gap", gap, src.place, reason
            gap = None
        yield "record", src.place, src.place + used, (headers, block)
        src.skip(used)
    if gap is not None:
        yield "gap", gap, src.place, reason


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write(rows: DataFrame, folder: str, volume: int = VOLUME) -> DataFrame:
    """Write rows (id string, payload binary, digest, refers_to) to archives; a row (archive, records) for each."""

    def volumes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        done, out, n = [], io.BytesIO(), 0

        def close() -> None:
            nonlocal out, n
            name = f"{folder}/{uuid.uuid4().hex}.warc.gz"
            store, at = _open(name)
            with store.open_output_stream(at + ".part", compression=None) as f:
                f.write(out.getbuffer())
            store.move(at + ".part", at)
            done.append((name, n))
            out, n = io.BytesIO(), 0

        for b in batches:
            for i, payload, digest, ref in zip(b["id"], b["payload"], b["digest"], b["refers_to"], strict=True):
                revisit = isinstance(ref, str)
                headers = {"WARC-Type": "revisit" if revisit else "response", "WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>", "WARC-Payload-Digest": f"sha1:{digest}", "X-Payload-Length": str(len(payload))}
                headers |= {"X-Page-ID": i} if isinstance(i, str) else {}
                headers |= {"X-Refers-To-Page-ID": ref} if revisit else {}
                out.write(member(record(headers, b"" if revisit else payload)))
                n += 1
                if out.tell() >= volume:
                    close()
        if n:
            close()
        yield pd.DataFrame(done, columns=["archive", "records"])

    return rows.mapInPandas(volumes, "archive string, records long")


def scan(archives: DataFrame) -> DataFrame:
    """Records and quarantined gaps of the archives named in column ``archive``.

    kind, archive, begin, end, reason, id, record_type, digest (of the bytes read, for a revisit the one it names), n_bytes, refers_to.
    """

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["kind", "archive", "begin", "end", "reason", "id", "record_type", "digest", "n_bytes", "refers_to"]
        for b in batches:
            for name in b["archive"]:
                store, at = _open(name)
                rows: list[tuple] = []
                with store.open_input_stream(at, compression=None) as f:
                    for kind, begin, end, what in read(f):
                        if kind == "gap":
                            rows.append((kind, name, begin, end, what, None, None, None, None, None))
                            continue
                        h, block = what
                        revisit = h.get("warc-type") == "revisit"
                        digest = h.get("warc-payload-digest", "").removeprefix("sha1:") if revisit else hashlib.sha1(block).hexdigest()
                        n = int(h.get("x-payload-length", 0)) if revisit else len(block)
                        rows.append((kind, name, begin, end, None, h.get("x-page-id"), h.get("warc-type"), digest, n, h.get("x-refers-to-page-id")))
                out = pd.DataFrame(rows, columns=columns)
                yield out.astype({"n_bytes": "Int64"})

    return archives.select("archive").mapInPandas(found, "kind string, archive string, begin long, end long, reason string, id string, record_type string, digest string, n_bytes long, refers_to string")


def archive(pages: DataFrame, folder: str, payload: str = "html", page_id: str = "page_id", least: int = LEAST) -> DataFrame:
    """Write a record per page; the table of archives."""
    bounded(pages.sparkSession)
    rows = pages.select(F.col(f"`{page_id}`").alias("id"), F.coalesce(F.col(f"`{payload}`").cast("binary"), F.lit(b"")).alias("payload"))
    keys = pages.select(F.col(f"`{page_id}`").alias("id"), F.coalesce(F.col(f"`{payload}`").cast("binary"), F.lit(b"")).alias("p")).filter(F.octet_length("p") >= least).select("id", F.sha1("p").alias("digest"))
    # only digests that come more than once are joined: payloads stay where they are read where that list is short
    again = keys.groupBy("digest").agg(F.count("*").alias("n"), F.max("id").alias("last")).filter("n > 1").select("digest", "last")
    again, _ = materialise(again, "again")
    rows = rows.withColumn("digest", F.sha1("payload")).join(again, "digest", "left")
    ref = F.when(~F.col("id").eqNullSafe(F.col("last")), F.col("last").cast("string"))
    named, _ = materialise(write(rows.select(F.col("id").cast("string").alias("id"), "payload", "digest", ref.alias("refers_to")), folder), "archives")
    return named


def op9(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    id_type = pages.schema["page_id"].dataType
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    folder = re.sub(r"^file:/+", "file:///", fs.makeQualified(path).toString())  # the store that Spark means, by its full name
    names = archive(pages, folder)
    # a task per archive: their names are a few bytes, which one partition would hold
    names = names.repartition(max(1, names.count()), "archive")
    out = scan(names).filter("kind = 'record'")
    return out.select(F.col("id").cast(id_type).alias("page_id"), F.col("n_bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", F.col("refers_to").cast(id_type).alias("refers_to"))


OP9_SQL = """
with p as (select page_id, encode(coalesce(html, '')) as b from pages),
q as (select page_id, octet_length(b) as payload_bytes, sha1(b) as payload_digest from p),
m as (select payload_digest, max(page_id) as last from q where payload_bytes >= 1000 group by 1)
select q.page_id, payload_bytes, q.payload_digest,
       case when last <> q.page_id then 'revisit' else 'response' end as record_type,
       case when last <> q.page_id then last end as refers_to
from q left join m on q.payload_digest = m.payload_digest and payload_bytes >= 1000
"""
