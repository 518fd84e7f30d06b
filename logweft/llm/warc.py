"""WARC archives: written as text parts by Spark, read back by byte ranges and boundary chains.

Reading cuts the files at the version mark, wherever it stands: each task turns the marks of its byte
range into candidate records with the offset of their successor, worked out from the
header's length field. Only candidates that can be reached from a file's start along these successors are
records; marks inside payloads are not. Inside a task the chain is followed at once, so that a candidate
points to the first boundary beyond the task's range; between ranges pointers are doubled.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..session import materialize, scratch_path

MARK = "WARC/1."
CUT = "\n" + MARK  # header lines hold no line ends, so no header is cut
#: Smaller payloads are always stored whole.
REVISIT_BYTES = 100
_DATE = "2024-01-01T00:00:00Z"  # fixed, so that writing twice gives the same archives
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


# ------------------------------------------------------------------ writing


def classify(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """(page_id, digest, refers_to) of the revisits: pages whose payload of at least ``least`` bytes a smaller page_id has too.

    Only ids and digests are shuffled. Rows with a null id are never revisits nor referred to.
    """
    digests = materialize(
        pages.filter((F.octet_length("html") >= least) & F.col("page_id").isNotNull()).select(
            "page_id", F.sha2(F.col("html").cast("binary"), 256).alias("digest")
        ),
        "digests",
    )
    shared = digests.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("__last"))
    return (
        digests.join(shared.filter(F.col("refers_to") < F.col("__last")).drop("__last"), "digest")
        .filter(F.col("page_id") != F.col("refers_to")).select("page_id", "digest", "refers_to").distinct()
    )


def _record() -> Column:
    """A record as text up to its last line end, which the writer adds."""
    revisit = F.col("refers_to").isNotNull()
    name = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    size = F.octet_length("html").cast("string")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size, F.lit("\r\n\r\n"))
    block = F.concat(http, F.when(revisit, "").otherwise(F.col("html")))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: <urn:page:"), name, F.lit(">"),
        F.lit(f"\r\nWARC-Date: {_DATE}\r\nWARC-Target-URI: "), F.col("uri"),
        F.lit("\r\nWARC-Payload-Digest: sha256:"), F.sha2(F.col("html").cast("binary"), 256),
        F.when(
            revisit,
            F.concat(F.lit(f"\r\nWARC-Profile: {_PROFILE}\r\nWARC-Refers-To: <urn:page:"), F.col("refers_to").cast("string"), F.lit(">")),
        ).otherwise(""),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
        F.octet_length(block).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(head, block, F.lit("\r\n"))


def write_warc(pages: DataFrame, path: str, least: int = REVISIT_BYTES) -> None:
    """One record per row of ``pages`` (page_id, url, html; null html: empty) in WARC files below ``path``.

    The files are Spark's own text parts with CRLF line ends, so failed tasks leave nothing
    behind. Of equal payloads of at least ``least`` bytes the smallest page_id is a response, the
    others are revisits. The join with the few revisits is left to Spark's own choice by size.
    Rows repeated under one page_id are written as often as they occur, each of the kind of its own payload.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
    )
    revisits = materialize(classify(rows, least), "revisits").select(F.col("page_id").alias("__page"), F.col("digest").alias("__digest"), "refers_to")
    # Header lines must not be broken by the address.
    uri = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\x00-\x20\x7f]", "%20")
    joined = rows.join(revisits, (F.col("page_id") == F.col("__page")) & (F.sha2(F.col("html").cast("binary"), 256) == F.col("__digest")), "left").withColumn("uri", uri)
    joined.select(_record().alias("value")).write.option("lineSep", "\r\n").text(path)


# ------------------------------------------------------------------ reading

_LENGTH = re.compile(rb"(?im)^content-length:[ \t]*(\d+)[ \t]*\r?$")
_SEGMENT = (
    "file string, block long, place long, at long, next long, exit long, kind string, page long, refers long, "
    "payload_bytes long, digest string, whole boolean, bytes long"
)


def _field(head: bytes, name: str) -> bytes | None:
    m = re.search(rb"(?im)^" + name.encode() + rb":[ \t]*([^\r\n]*?)[ \t]*\r?$", head)
    return m[1] if m else None


def _page(value: bytes | None) -> int | None:
    m = re.fullmatch(rb"<urn:page:(-?\d+)>", value or b"")
    return int(m[1]) if m else None


def _parse(data: bytes) -> tuple[int, bytes, int] | None:
    """(length of the record, header, where the block starts) if ``data`` begins as a record.

    The header, of any length, ends at the first empty line. Its lines hold no line ends, so it is never cut by a mark.
    """
    if not re.match(rb"WARC/1\.\d\r\n", data):
        return None
    end = data.find(b"\r\n\r\n")
    if end < 0:
        return None
    m = _LENGTH.search(data[:end])
    return (end + 4 + int(m[1]) + 4, data[: end + 2], end + 4) if m else None


def _payload(data: bytes, head: bytes, block: int, length: int) -> tuple[int | None, str | None]:
    """(bytes, digest) of the full payload; of a revisit as its header states them."""
    body = data[block : length - 4]
    http = body.find(b"\r\n\r\n")
    if _field(head, "warc-type") == b"revisit":
        m = _LENGTH.search(body)
        digest = _field(head, "warc-payload-digest") or b""
        return int(m[1]) if m else None, digest.rpartition(b":")[2].decode() or None
    payload = body[http + 4 :] if http >= 0 else body
    return len(payload), hashlib.sha256(payload).hexdigest()


def _segments(spark: SparkSession, path: str) -> DataFrame:
    """The archives cut at every mark: file, block (start of the byte range), segment without the marks around it."""
    text = spark.read.option("lineSep", CUT).text(path)
    return text.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.col("value").cast("binary").alias("segment"),
    )


def _ranges(batches):
    """(file, block, place, data) of the segments in turn; places are counted from the range's first segment.

    A segment's data begin with its mark; only the first of a file has none before it.
    """
    key, offset = None, 0
    for batch in batches:
        for file, block, segment in zip(*[batch.column(i).to_pylist() for i in range(3)]):
            if (file, block) != key:
                key, offset = (file, block), 0
            first = block == 0 and offset == 0
            yield file, block, offset - (0 if first else len(MARK)), segment if first else MARK.encode() + segment
            offset += len(segment) + len(CUT)


def _candidates(batches):
    def closed(file, block, rows):
        at = {r[0]: i for i, r in enumerate(rows)}
        leave = [None] * len(rows)
        for i in range(len(rows) - 1, -1, -1):  # follow the chain to the first boundary beyond this range
            nxt = rows[i][1]
            leave[i] = None if nxt is None else leave[at[nxt]] if nxt in at else nxt
        place, nxt, kind, page, refers, size, digest, whole, data = zip(*rows)
        long = pa.int64()
        return pa.RecordBatch.from_arrays(
            [
                pa.array([file] * len(rows), pa.string()), pa.array([block] * len(rows), long), pa.array(place, long),
                pa.array(place, long), pa.array(nxt, long), pa.array(leave, long), pa.array(kind, pa.string()), pa.array(page, long),
                pa.array(refers, long), pa.array(size, long), pa.array(digest, pa.string()), pa.array(whole, pa.bool_()),
                pa.array(data, long),
            ],
            names=[f.split()[0] for f in _SEGMENT.split(", ")],
        )

    key, rows = None, []
    for file, block, place, data in _ranges(batches):
        if (file, block) != key:
            if key:
                yield closed(*key, rows)
            key, rows = (file, block), []
        row = (None,) * 7
        if found := _parse(data):
            length, head, start = found
            whole = len(data) + 1 == length or len(data) == length  # the cut takes the last line end
            about = _payload(data, head, start, length) if whole else (None, None)
            kind = (_field(head, "warc-type") or b"").decode("utf-8", "replace")
            row = (place + length, kind, _page(_field(head, "warc-record-id")), _page(_field(head, "warc-refers-to")), *about, whole)
        rows.append((place, *row, len(data) + len(CUT)))
    if key:
        yield closed(*key, rows)


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """Stored table of all segments: absolute offsets of start (at), successor (next) and chain exit, null if no record.

    The segments of a file are its bytes without gaps, so a range starts where those before it end: a
    running sum over one row per range.
    """
    found = materialize(_segments(spark, path).mapInArrow(_candidates, _SEGMENT), "warc-segments")
    # A range's segments cover it up to the last one's end, counted from the first one's start.
    length = F.max(F.col("place") + F.col("bytes"))
    own = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    base = found.groupBy("file", "block").agg(length.alias("__bytes")).select(
        "file", "block", F.coalesce(F.sum("__bytes").over(own), F.lit(0)).alias("__base")
    )
    moved = [(F.col(c) + F.col("__base")).alias(c) for c in ("at", "next", "exit")]
    return materialize(
        found.join(base, ["file", "block"]).select(
            "file", "block", "place", *moved, "kind", "page", "refers", "payload_bytes", "digest", "whole"
        ),
        "warc-candidates",
    )


def _entries(found: DataFrame) -> DataFrame:
    """(file, at): where the true chain of each file enters a byte range, by pointer jumping from the file's start."""
    targets = found.filter("exit IS NOT NULL").select("file", F.col("exit").alias("at")).distinct()
    jump = materialize(found.join(targets, ["file", "at"], "left_semi").filter("exit IS NOT NULL").select("file", "at", F.col("exit").alias("to")), "jump")
    start = found.filter((F.col("at") == 0) & F.col("next").isNotNull())
    reached = materialize(
        start.select("file", "at").unionByName(
            start.filter("exit IS NOT NULL").select("file", F.col("exit").alias("at"))
        ).distinct(),
        "reached",
    )
    n = reached.count()
    while True:
        # All reached within 2^k hops; their jumps of 2^k hops reach the next 2^k.
        reached = materialize(
            reached.unionByName(reached.join(jump, ["file", "at"]).select("file", F.col("to").alias("at"))).distinct(), "reached"
        )
        more = reached.count()
        if more == n:
            return reached
        n = more
        over = jump.select("file", F.col("at").alias("to"), F.col("to").alias("__to"))
        jump = materialize(jump.join(over, ["file", "to"]).select("file", "at", F.col("__to").alias("to")), "jump")


def _follow(table: pa.Table) -> pa.Table:
    """The rows of one byte range that lie on the chain from its entry, and what lies inside their spans."""
    table = table.sort_by("at")
    at, nxt, entry = (table[c].to_pylist() for c in ("at", "next", "__entry"))
    index = {a: i for i, a in enumerate(at)}
    on = [False] * len(at)
    for i in range(len(at)):
        if entry[i] and not on[i]:
            while i is not None and not on[i] and nxt[i] is not None:
                on[i] = True
                i = index.get(nxt[i])
    return table.drop_columns(["__entry"]).append_column("reached", pa.array(on, pa.bool_()))


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of the WARC files below ``path``: file, at, kind, page_id, refers_to, payload_bytes, payload_digest.

    Payloads are those inside the HTTP responses; a revisit has the size and digest of the
    payload it stands for. A file that does not begin with a record has none; records after a
    broken header or a wrong length are not reached; a record cut off at the end of its file has
    no digest. Empty archives give no rows.
    """
    found = candidates(spark, path)
    entry = _entries(found).withColumn("__entry", F.lit(True))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found.schema.fields) + ", reached boolean"
    chained = materialize(
        found.join(entry, ["file", "at"], "left").select(*found.columns, F.coalesce("__entry", F.lit(False)).alias("__entry"))
        .groupBy("file", "block").applyInArrow(_follow, schema),
        "warc-chain",
    )
    records = chained.filter("reached")
    out = records.select(
        "file", "at", "kind", F.col("page").alias("page_id"), F.col("refers").alias("refers_to"), "payload_bytes",
        F.col("digest").alias("payload_digest"), "whole",
    )
    torn = records.filter("NOT whole")
    if torn.isEmpty():
        return out.drop("whole")
    glued = _glue(spark, path, chained, torn)
    whole = out.filter("whole").drop("whole")
    rest = out.filter("NOT whole").drop("whole", "payload_bytes", "payload_digest").join(glued, ["file", "at"], "left")
    return whole.unionByName(rest)


def _glue(spark: SparkSession, path: str, chained: DataFrame, torn: DataFrame) -> DataFrame:
    """Size and digest of records whose payload holds marks: their segments are read again and joined.

    Spans are cut into blocks of 2^20 bytes to find the segments inside by equality.
    """
    block = F.shiftright("at", 20)
    owner = torn.select(
        "file", F.col("at").alias("owner"), F.col("next").alias("end"),
        F.explode(F.sequence(F.shiftright("at", 20), F.shiftright(F.col("next") - 1, 20))).alias("__slice"),
    )
    needed = materialize(
        chained.select("file", "block", "place", "at", block.alias("__slice")).join(owner, ["file", "__slice"])
        .filter((F.col("at") >= F.col("owner")) & (F.col("at") < F.col("end"))).select("file", "block", "place", "at", "owner"),
        "warc-torn",
    )

    def again(batches):
        for file, at, place, data in _ranges(batches):
            yield pa.RecordBatch.from_arrays(
                [pa.array([file]), pa.array([at], pa.int64()), pa.array([place], pa.int64()), pa.array([data], pa.binary())],
                names=["file", "block", "place", "data"],
            )

    data = _segments(spark, path).mapInArrow(again, "file string, block long, place long, data binary")
    parts = data.join(needed, ["file", "block", "place"]).groupBy("file", "owner").agg(
        F.sort_array(F.collect_list(F.struct("at", "data"))).alias("parts")  # one record's segments
    )

    def join(batches):
        for batch in batches:
            files, owners, lists = (c.to_pylist() for c in batch.columns)
            rows = []
            for parts in lists:
                data = b"\n".join(p["data"] for p in parts)
                length, head, start = _parse(data)
                rows.append(_payload(data, head, start, length) if len(data) + 1 >= length else (None, None))
            yield pa.RecordBatch.from_arrays(
                [pa.array(files, pa.string()), pa.array(owners, pa.int64()), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())],
                names=["file", "at", "payload_bytes", "payload_digest"],
            )

    return parts.mapInArrow(join, "file string, at long, payload_bytes long, payload_digest string")


def archive(spark: SparkSession, pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``pages`` as WARC archives (below ``path``, else in the shared folder) and read them back."""
    path = path or scratch_path(spark, "warc")
    write_warc(pages, path)
    return read_warc(spark, path)
