"""WARC archives: a writer with revisit records and a reader that salvages damaged files.

The writer makes one gzip member per record (or plain records) and leaves the files to Spark's text writer,
whose record end is the last byte of each record. The reader checks gzip sums, version line, header lines,
content length, record end and payload digest. After a failed check it looks for the next place where a member
or a version line begins and a whole record passes the checks; the bytes skipped are logged as a gap. Inside a
member, what was decompressed before an error is searched in the same way: such a gap has the member's byte range
(for a broken member, up to where the search goes on) and, as ``inner_start`` and ``inner_end``, its range in the content.
For records of a broken member only their own checks vouch, as in a plain archive.

Defined results: a null payload is empty; a null page_id has no id in the archive and comes back null, and it is no
target of revisits; rows with one page_id and payload are responses alike; url characters that would break a
header line are percent-encoded; an empty table gives no archives and no rows. An archive is read whole by one
task, so ``RECORDS_PER_FILE`` bounds it when written here.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from querysieve.session import broadcast_if_small, ship

REVISIT_BYTES = 100
RECORDS_PER_FILE = 1000
DATE = "2024-01-01T00:00:00Z"
MEMBER, VERSION = b"\x1f\x8b\x08", re.compile(rb"WARC/1\.[01]\r\n")
# An empty member ends in a zero byte; as padding after each record it lets the writer's record end be one byte.
PADDING = gzip.compress(b"", mtime=0)
SCANNED = (
    "file string, kind string, start bigint, end bigint, inner_start bigint, inner_end bigint, reason string, record_type string, page_id bigint, "
    "refers_to bigint, payload_bytes bigint, payload_digest string, url string, payload binary"
)


# ---- writer ------------------------------------------------------------------------------


def with_revisits(pages: DataFrame) -> DataFrame:
    """``page_id, url, html, digest, payload_bytes, refers_to``: the page whose payload a revisit repeats."""
    html = F.coalesce("html", F.lit(""))
    keyed = pages.select(
        "page_id", "url", html.alias("html"), F.sha2(html, 256).alias("digest"),
        F.octet_length(html).cast("bigint").alias("payload_bytes"),
    )
    firsts = keyed.where(F.col("payload_bytes") >= REVISIT_BYTES).groupBy("digest").agg(
        F.min("page_id").alias("_first"), F.count("*").alias("_n")
    ).where((F.col("_n") > 1) & F.col("_first").isNotNull())
    side = broadcast_if_small(firsts.select(F.col("digest").alias("_digest"), "_first"))
    joined = keyed.join(side, F.col("digest") == F.col("_digest"), "left")
    again = F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first"))
    return joined.withColumn("refers_to", F.when(again, F.col("_first"))).drop("_first", "_digest")


def record_text(keyed: DataFrame, date: str = DATE) -> DataFrame:
    """One column ``record``: header lines, HTTP head and, for responses, the payload."""
    line = lambda name, value: F.concat(F.lit(name + ": "), value, F.lit("\r\n"))
    page = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    url = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\x00-\x20\x7F]", "%20")
    revisit = F.col("refers_to").isNotNull()
    head = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.col("payload_bytes").cast("string"), F.lit("\r\n\r\n"),
    )
    block = F.concat(head, F.when(revisit, F.lit("")).otherwise(F.col("html")))
    fields = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", page(F.col("page_id"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", url),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        line("X-Payload-Bytes", F.col("payload_bytes").cast("string")),
        F.when(revisit, F.concat(
            line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
            line("WARC-Refers-To", page(F.col("refers_to"))),
        )).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length("_block").cast("string")),
        F.lit("\r\n"),
    )
    return keyed.withColumn("_block", block).select(F.concat(fields, F.col("_block"), F.lit("\r\n\r\n")).alias("record"))


def member(record: bytes) -> bytes:
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress(record) + squeeze.flush() + PADDING


def write_archives(pages: DataFrame, path: str, compress: bool = True, per_file: int = RECORDS_PER_FILE) -> None:
    records = record_text(with_revisits(pages))
    end = "\n"
    if compress:
        def squeeze(batches):
            for batch in batches:
                made = [member(r.as_buffer().to_pybytes())[:-1] for r in batch.column(0)]
                yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], names=["record"])

        ship(pages.sparkSession)
        records, end = records.mapInArrow(squeeze, "record binary"), "\0"
    else:
        records = records.select(F.expr("substring(cast(record AS binary), 1, octet_length(record) - 1)").alias("record"))
    records.select(F.col("record").cast("string").alias("value")).write.option("lineSep", end).option(
        "maxRecordsPerFile", per_file
    ).text(path)


# ---- reader ------------------------------------------------------------------------------


class Damaged(ValueError):
    """A check that failed."""


def parse_record(data, at: int) -> tuple[dict, int]:
    """The record at ``at`` and where it ends."""
    if not VERSION.match(data, at):
        raise Damaged("no version line")
    stop = data.find(b"\r\n\r\n", at)
    if stop < 0:
        raise Damaged("header without end")
    fields = {}
    for row in data[at:stop].split(b"\r\n")[1:]:
        name, colon, value = row.partition(b":")
        if not colon:
            raise Damaged("header line without colon")
        fields[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    if not {"warc-type", "warc-record-id"} <= fields.keys():
        raise Damaged("mandatory field")
    length = fields.get("content-length", "")
    if not length.isdecimal():
        raise Damaged("no content length")
    start, end = stop + 4, stop + 4 + int(length)
    if data[end:end + 4] != b"\r\n\r\n":
        raise Damaged("content length")
    block = data[start:end]
    payload = block.partition(b"\r\n\r\n")[2] if fields.get("content-type", "").startswith("application/http") else block
    digest = fields.get("warc-payload-digest", "")
    found = hashlib.sha256(payload).hexdigest()
    revisit = fields.get("warc-type") == "revisit"
    if digest.startswith("sha256:") and not revisit and digest != "sha256:" + found:
        raise Damaged("payload digest")
    number = lambda name: int(m[1]) if (m := re.fullmatch(r"<urn:page:(-?\d+)>", fields.get(name, ""))) else None
    size = fields.get("x-payload-bytes", "")
    return {
        "record_type": fields.get("warc-type"), "page_id": number("warc-record-id"),
        "refers_to": number("warc-refers-to"), "url": fields.get("warc-target-uri"),
        "payload_bytes": (int(size) if size.isdecimal() else None) if revisit else len(payload),
        "payload_digest": digest.removeprefix("sha256:") if revisit else found,
        "payload": None if revisit else payload,
    }, end + 4


def inflate(data, at: int) -> tuple[bytes, int, str | None, list[tuple[int, int]]]:
    """A gzip member's content, where it ends and what broke it; fed in steps, so that what follows is not copied each time.

    Of a broken member, the content is what comes before the error, and the end is the byte that failed. The list has
    the place and the content so far before each step.
    """
    out, inner, size, steps = [], zlib.decompressobj(31), 0, []
    view = memoryview(data)
    while not inner.eof:
        step = view[at:at + 65536]
        steps.append((at, size))
        if not step:
            return b"".join(out), at, "member without end", steps
        try:
            out.append(inner.decompress(step))
        except zlib.error as e:
            again = zlib.decompressobj(31)
            for place, _ in steps[:-1]:
                again.decompress(view[place:place + 65536])
            rest, at = _until_error(again, step, at)
            return b"".join([*out, rest]), at, f"gzip: {e}", steps
        size += len(out[-1])
        at += len(step) - len(inner.unused_data)
    return b"".join(out), at, None, steps


def _until_error(inner, step, at: int) -> tuple[bytes, int]:
    """What a step gives before its error, found by feeding halves; and the place of the byte that fails."""
    out = []
    while len(step) > 1:
        half, kept = len(step) // 2, inner.copy()
        try:
            out.append(inner.decompress(step[:half]))
            step, at = step[half:], at + half
        except zlib.error:
            inner, step = kept, step[:half]
    try:  # one byte may stand for many
        piece = inner.decompress(step, 1)
        while piece or inner.unconsumed_tail:
            out.append(piece)
            piece = inner.decompress(inner.unconsumed_tail, 1)
    except zlib.error:
        pass
    return b"".join(out), at


def spans(data: bytes, unit_at, following) -> Iterator[tuple[int, int, object]]:
    """``(start, end, found)`` of whole units and, with the reason as ``found``, of the ranges between them."""
    at, gap, reason = 0, None, None
    while at < len(data):
        try:
            found, end = unit_at(data, at)
        except Damaged as e:
            if gap is None:
                gap, reason = at, str(e)
            at = following(at + 1)
            continue
        if gap is not None:
            yield gap, at, reason
            gap = None
        yield at, end, found
        at = end
    if gap is not None:
        yield gap, len(data), reason


def next_version(data: bytes, start: int) -> int:
    found = VERSION.search(data, start)
    return found.start() if found else len(data)


def inside(content: bytes) -> Iterator[dict]:
    """Records and gaps of a member's content, with their ranges in it."""
    for start, end, found in spans(content, parse_record, lambda at: next_version(content, at)):
        place = {"inner_start": start, "inner_end": end}
        yield place | ({"kind": "gap", "reason": found} if isinstance(found, str) else {"kind": "record"} | found)


def scan(data: bytes) -> Iterator[dict]:
    """Records and gaps of an archive in order, with their byte ranges."""
    ahead = {"member": -1, "version": -1}

    def following(start: int, plain: int = 0) -> int:
        """The next place where a member begins or, from ``plain`` on, a version line."""
        if ahead["member"] < start:
            found = data.find(MEMBER, start)
            ahead["member"] = len(data) if found < 0 else found
        if ahead["version"] < max(start, plain):
            ahead["version"] = next_version(data, max(start, plain))
        return min(ahead.values())

    def unit_at(data: bytes, at: int) -> tuple[list[dict], int]:
        """What the member or plain record at ``at`` holds, and where it ends."""
        if data[at:at + 3] != MEMBER:
            found, end = parse_record(data, at)
            return [found | {"kind": "record"}], end
        content, end, broken, steps = inflate(data, at)
        held = list(inside(content))
        if not any(r["kind"] == "record" for r in held) and (broken or held):
            raise Damaged(broken or held[0]["reason"])
        if broken:
            # Lost bytes let a member run into the next ones, so members are looked for behind the last good record;
            # version lines before the error are stored bytes of this member, which were searched.
            good = max(r["inner_end"] for r in held if r["kind"] == "record")
            end = following(max([at + 1, *(place for place, size in steps if size <= good)]), end)
            if held[-1]["kind"] == "gap":
                held[-1]["reason"] = broken
            else:
                held.append({"kind": "gap", "reason": broken, "inner_start": len(content), "inner_end": len(content)})
        return held, end

    for start, end, found in spans(data, unit_at, following):
        if isinstance(found, str):
            yield {"kind": "gap", "start": start, "end": end, "reason": found}
        else:
            yield from ({"start": start, "end": end} | r for r in found)


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records (``kind`` is record) and quarantined byte ranges (``kind`` is gap) of the archives below ``path``."""
    names = [f.split(" ")[0] for f in SCANNED.split(", ")]
    types = {"payload": pa.binary()} | dict.fromkeys(("start", "end", "inner_start", "inner_end", "page_id", "refers_to", "payload_bytes"), pa.int64())

    def table(rows):
        return pa.RecordBatch.from_arrays(
            [pa.array([r.get(n) for r in rows], types.get(n, pa.string())) for n in names], names=names
        )

    def read(batches):
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1)):
                held, size = [], 0
                for row in scan(content.as_py()):
                    size += len(row.get("payload") or b"") + 200
                    held.append({"file": name.as_py()} | row | ({} if payloads else {"payload": None}))
                    if size > 4_000_000:
                        yield table(held)
                        held, size = [], 0
                yield table(held)

    ship(spark)
    try:
        files = spark.read.format("binaryFile").load(path).select("path", "content")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        files = spark.createDataFrame([], "path string, content binary")
    return files.mapInArrow(read, SCANNED)
