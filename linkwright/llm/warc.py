"""WARC archives: a writer and a salvage reader (operator 3).

The writer makes one record per page: the first page (smallest page_id) of
those with equal payloads is a `response`, the others are `revisit` records
that refer to it and carry its digest. Which is which is found on digests
alone; pages that are certainly no revisits are written by the tasks that scan
them, and only possible revisits (by a bitmap of fixed size) are joined.
Every record is a gzip member of its own. A task gathers members up to
ARCHIVE_BYTES, and Spark's text writer puts each such archive out as it is, as
a file of its own, so archives are ordinary .warc.gz files of bounded size in
whatever store Spark writes to.

The reader takes archives whole (of up to 2 GB, Spark's limit for a value),
compressed or not. Where a member or record fails its checks (checksum, length,
header, digests), it searches on for the next member or version line that does
parse, recovers the records from there, and reports the bytes in between as a
quarantined gap. A member is not given up as a whole: the records that come
before the place where its data end or break are checked and kept, and a damaged
record inside a member is skipped to the next version line in it.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, maybe_in, salted_join, scratch_path

VERSION = b"WARC/1.1"
VERSION_LINE = re.compile(rb"WARC/\d+\.\d+\r\n")
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payloads of at least so many bytes are written as revisits if they repeat.
MIN_REVISIT_BYTES = 0
#: Bytes of an archive at most, unless one record alone has more.
ARCHIVE_BYTES = 16_000_000
#: What stands at the end of an archive: an empty gzip member.
EMPTY_MEMBER = gzip.compress(b"", mtime=0)
MAGIC = b"\x1f\x8b\x08"
RECORD_ID = "urn:x-page:{}"


def digest_text(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def record(page_id: int | None, url: str | None, payload: bytes, sha1: bytes, length: int, refers_to: int | None, revisit: bool) -> bytes:
    """One uncompressed record. A revisit keeps the HTTP header, with the payload's length, and not the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block = http if revisit else http + payload
    name = RECORD_ID.format(page_id) if page_id is not None else f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, sha1.hex())}"
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<{name}>"), ("WARC-Date", DATE)]
    if url is not None:
        fields.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{RECORD_ID.format(refers_to)}>")]
    fields += [
        ("WARC-Payload-Digest", f"sha1:{digest_text(sha1)}"),
        ("WARC-Block-Digest", f"sha1:{digest_text(hashlib.sha1(block).digest())}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    head = VERSION + b"\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in fields)
    return head + b"\r\n" + block + b"\r\n\r\n"


class Found(NamedTuple):
    """A record (fields, block) or, if fields is None, a gap of quarantined bytes (reason)."""

    start: int
    end: int
    fields: dict[str, str] | None
    block: bytes
    reason: str


class Damaged(ValueError):
    pass


def parse(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """The record at `at` of uncompressed bytes: fields (names in lower case), block, end. Raises Damaged."""
    version = VERSION_LINE.match(data, at)
    if not version:
        raise Damaged("no version line")
    # a header is as long as its fields are; the next version line or the end of the data bounds it
    stop = data.find(b"\r\n\r\n", at)
    if stop < 0 or data.find(b"\r\nWARC/", at, stop) >= 0:
        raise Damaged("header without end")
    fields = {}
    for line in data[version.end() : stop].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damaged("header line without colon")
        fields[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
    size = fields.get("content-length", "")
    if not size.isdecimal() or "warc-type" not in fields:
        raise Damaged("header without length or type")
    low, high = stop + 4, stop + 4 + int(size)
    if data[high : high + 4] != b"\r\n\r\n":
        raise Damaged("record cut short or of another length")
    block = data[low:high]
    told = fields.get("warc-block-digest", "")
    if told.startswith("sha1:") and told[5:] != digest_text(hashlib.sha1(block).digest()):
        raise Damaged("block digest differs")
    return fields, block, high + 4


def member(data: bytes, at: int) -> tuple[bytes, int | None, str]:
    """What can be unpacked of the gzip member at `at`, its end (None if it is damaged or cut short) and the damage.

    The checksum stands at a member's end, so what precedes damage is unpacked
    unchecked; records' own digests then tell what of it is good.
    """
    view, unpack, out = memoryview(data), zlib.decompressobj(31), []
    pos = at
    while not unpack.eof:
        if pos >= len(data):
            out.append(unpack.flush())
            return b"".join(out), None, "member cut short"
        piece = view[pos : pos + 65_536]
        try:
            out.append(unpack.decompress(piece))
        except zlib.error as e:
            return b"".join([*out, _before_damage(view, at, pos, len(piece))]), None, f"gzip: {e}"
        pos += len(piece)
    return b"".join(out), pos - len(unpack.unused_data), ""


def _before_damage(view: memoryview, at: int, pos: int, size: int) -> bytes:
    """What the bytes pos to pos + size of the member at `at` give until they break: a failing call gives nothing."""
    unpack, out = zlib.decompressobj(31), []
    for low in range(at, pos, 65_536):
        unpack.decompress(view[low : min(low + 65_536, pos)])
    try:
        for i in range(pos, pos + size, 64):
            out.append(unpack.decompress(view[i : min(i + 64, pos + size)]))
    except zlib.error:
        pass
    return b"".join(out)


def _records(data: bytes, checked: bool) -> Iterator[tuple[int, int, dict[str, str] | None, bytes, str]]:
    """start, end, fields, block, "" of the plain records of data; fields None and the reason for what is none.

    checked: whether a checksum vouches for the bytes. Where none does, a record
    counts only if it has a block digest.
    """
    at, bad, why = 0, None, ""
    while at < len(data):
        try:
            fields, block, end = parse(data, at)
            if not checked and not fields.get("warc-block-digest", "").startswith("sha1:"):
                raise Damaged("no digest in a damaged member")
        except Damaged as e:
            if bad is None:
                bad, why = at, str(e)
            found = VERSION_LINE.search(data, at + 1)
            at = found.start() if found else len(data)
            continue
        if bad is not None:
            yield bad, at, None, b"", why
            bad = None
        yield at, end, fields, block, ""
        at = end
    if bad is not None:
        yield bad, len(data), None, b"", why


def _next_start(data: bytes, at: int) -> int:
    """Where a member or a version line may begin, from `at` on; the end if nowhere."""
    line = VERSION_LINE.search(data, at)
    places = [p for p in (data.find(MAGIC, at), line.start() if line else -1) if p >= 0]
    return min(places, default=len(data))


def _unit(data: bytes, at: int) -> tuple[list[Found], int | None, str]:
    """The records and gaps of the member or plain record at `at`, its end (None if it has none), and the damage.

    What is found inside a member has the member's start and, if that is known,
    its end; a gap inside it says so.
    """
    if data[at : at + len(MAGIC)] != MAGIC:
        try:
            fields, block, end = parse(data, at)
        except Damaged as e:
            return [], None, str(e)
        return [Found(at, end, fields, block, "")], end, ""
    content, end, why = member(data, at)
    upto = len(data) if end is None else end
    found = [Found(at, upto, fields, block, why and f"inside a member: {why}") for _, _, fields, block, why in _records(content, end is not None)]
    while end is None and found and found[-1].fields is None:
        found.pop()  # the gap that follows covers it
    if end is not None or found:
        return found, end, why
    return [], None, why


def salvage(data: bytes) -> Iterator[Found]:
    """All records that can be recovered from an archive, and the gaps between them."""
    at, bad, why = 0, None, ""
    while at < len(data):
        records, end, damage = _unit(data, at)
        if end is None:
            following = _next_start(data, at + 1)
            if bad is None:
                bad, why = at, damage
            elif records:
                yield Found(bad, at, None, b"", why)
                bad, why = at, damage
            yield from (x._replace(end=following) for x in records)
            at = following
            continue
        if bad is not None:
            yield Found(bad, at, None, b"", why)
            bad = None
        yield from records
        at = end
    if bad is not None:
        yield Found(bad, len(data), None, b"", why)


def revisits(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """id, sha, refers_to of the pages whose payload an earlier page (smaller page_id) has."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    told = pages.select(F.col("page_id").cast("long").alias("id"), F.unhex(F.sha1(payload)).alias("sha"), F.length(payload).alias("bytes"))
    told = materialize(told.where(F.col("bytes") >= min_bytes).select("id", "sha"), "warc-digests")
    first = told.groupBy("sha").agg(F.min("id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1 and refers_to is not null").drop("n")
    again = salted_join(told, materialize(first, "warc-firsts"), "sha", "id", "inner")
    return materialize(again.where(~F.col("id").eqNullSafe(F.col("refers_to"))).distinct(), "warc-revisits")


def write_archives(pages: DataFrame, path: str, min_bytes: int = MIN_REVISIT_BYTES) -> None:
    """Write the pages (page_id, url, html) as compressed archives under path.

    A null html is an empty payload, a null url an absent header. Rows that
    repeat a page_id and payload are all written alike; a null page_id is
    written as a response with a uuid, or as a revisit of a page that has an id.
    Other columns are ignored; an empty table gives archives without records.
    """
    again = revisits(pages, min_bytes)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    marked = maybe_in(rows, "page_id", again.select("id"))
    plain = marked.where(~F.col("_maybe")).select("page_id", "url", "payload", F.lit(None).cast("long").alias("refers_to"))
    some = marked.where("_maybe").withColumn("own", F.unhex(F.sha1("payload")))
    some = some.join(again, F.col("page_id").eqNullSafe(F.col("id")) & (F.col("own") == F.col("sha")), "left").select("page_id", "url", "payload", "refers_to")

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for page_id, url, payload, refers_to in zip(*(batch.column(i) for i in range(4)), strict=True):
                body, first = payload.as_py(), refers_to.as_py()
                text = record(page_id.as_py(), url.as_py(), body, hashlib.sha1(body).digest(), len(body), first, first is not None)
                one = gzip.compress(text, 6, mtime=0)
                if held and size + len(one) > ARCHIVE_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["value"])
                    held, size = [], 0
                held.append(one)
                size += len(one)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["value"])

    archives = plain.unionByName(some).mapInArrow(run, "value binary").select(F.col("value").cast("string"))
    # the charset is only that of the separator: Spark writes a string's bytes as they are
    writer = archives.write.option("encoding", "ISO-8859-1").option("lineSep", EMPTY_MEMBER.decode("latin-1"))
    writer.option("maxRecordsPerFile", 1).text(path)


RECORDS = "path string, start long, end long, reason string, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _page(name: str | None) -> int | None:
    found = re.fullmatch(r"<urn:x-page:(-?\d+)>", name or "")
    return int(found[1]) if found else None


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Records and gaps of all archives under path.

    A gap has a reason and no record_type. A response's payload is checked
    against its digest; one that differs is a gap too.
    """

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                name, out = batch.column(0)[i].as_py(), []
                for x in salvage(batch.column(1)[i].as_py()):
                    if x.fields is None:
                        out.append((name, x.start, x.end, x.reason, *[None] * 6))
                        continue
                    kind, told = x.fields["warc-type"], x.fields.get("warc-payload-digest", "").removeprefix("sha1:")
                    head, _, payload = x.block.partition(b"\r\n\r\n")
                    size = re.search(rb"(?im)^content-length: *(\d+)", head)
                    if kind == "response" and digest_text(hashlib.sha1(payload).digest()) != told:
                        out.append((name, x.start, x.end, "payload digest differs", *[None] * 6))
                        continue
                    n = len(payload) if kind == "response" else int(size[1]) if size else None
                    out.append((name, x.start, x.end, None, _page(x.fields.get("warc-record-id")), x.fields.get("warc-target-uri"), n, told, kind, _page(x.fields.get("warc-refers-to"))))
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64())
                cols = zip(*out, strict=True) if out else [[]] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], [f.split()[0] for f in RECORDS.split(", ")])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, RECORDS)


def quarantine(found: DataFrame) -> DataFrame:
    """The gaps among what `read_archives` found: path, start, end, reason."""
    return found.where("record_type is null").select("path", "start", "end", "reason")


class Incomplete(RuntimeError):
    """Not all pages came back from the archives."""


def round_trip(pages: DataFrame, quarantined: str | None = None) -> DataFrame:
    """Write the pages to the shared folder and read them back: one row per record.

    Gaps are written as a table to the path `quarantined`, by default one in the
    shared folder. If there are any, or fewer records than pages, Incomplete is
    raised and names that table: no page is lost without a word.
    """
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_archives(pages, path)
    found = materialize(read_archives(spark, path), "warc-found")
    told = found.agg(F.count_if(F.col("record_type").isNotNull()).alias("records"), F.count_if(F.col("record_type").isNull()).alias("gaps")).first()
    wanted = pages.count()
    if told["gaps"] or told["records"] != wanted:
        quarantined = quarantined or scratch_path(spark, "warc-quarantine")
        quarantine(found).write.mode("overwrite").parquet(quarantined)
        raise Incomplete(f"{told['records']} of {wanted} pages came back; {told['gaps']} gaps are listed in {quarantined}")
    return found.where("record_type is not null").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
