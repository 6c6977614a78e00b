"""WARC archives: a writer, and a reader that splits compressed archives.

Writer: each record is a gzip member of its own; of equal payloads of
``min_revisit`` bytes or more, the record with the largest id is a response and
the others are revisits that refer to it and carry no payload.  An archive is
one row of Spark's text writer, a file of its own; that writer's line end is set to
a zero byte, which gzip allows as padding.

Reader: Spark's text source splits archives into byte ranges and delivers what
lies between gzip magics; a task owns what starts in its range and reads past the
end for its last piece.  A magic can occur inside compressed data, so each piece
is a candidate: it starts a record if its gzip header is sound and what it
decompresses to starts with a WARC version.  A piece that does not start one, or
is too short to tell, continues the piece before it; where a member ends inside
the joined bytes, the next candidate starts.  The few that continue over a
range's end are put together by file afterwards.

Archives must not be named ``.gz``: Hadoop decompresses such files as a whole,
and they cannot be split.

Defined cases: a null html is an empty payload; a null id is a record without
id, never referred to; of rows with the same largest id and equal payloads each
is a response; a null url is an empty target; line breaks in a url are encoded;
an empty table gives no archives and no records; extra columns are not carried.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import if_small, written

#: Fixed values of the formats.
_MAGIC = b"\x1f\x8b\x08"
_VERSION = b"WARC/1."
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_RECORD = "id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


def with_revisits(pages: DataFrame, id_col: str, url_col: str, html_col: str, min_revisit: int = 1000, salts: int = 16, max_broadcast_bytes: int = 64 << 20) -> DataFrame:
    """(id, url, payload, digest, refers_to): ``refers_to`` is null for a response."""
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    groups = (
        rows.filter(F.length("payload") >= min_revisit)
        .groupBy("digest").agg(F.max("id").alias("largest"), F.count("*").alias("n"))
        .filter("n > 1").select("digest", "largest")
    )
    # Beyond the bound of a broadcast, the rows of a payload meet their group in as many tasks as there are salts.
    groups = if_small(written(groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))), max_broadcast_bytes)
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("id", "url"), F.lit(salts)).cast("int"))
    return rows.join(groups, ["digest", "salt"], "left").select("id", "url", "payload", "digest", F.when(F.col("id").isNull() | (F.col("id") < F.col("largest")), F.col("largest")).alias("refers_to"))


def build_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, level: int = 6) -> bytes:
    """One gzip member with one WARC record."""
    target = "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}"]
    if page_id is not None:
        head.append(f"WARC-Record-ID: <urn:page:{page_id}>")
    head += [f"WARC-Target-URI: {target}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}", "Content-Type: text/html; charset=utf-8"]
    if refers_to is not None:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
        payload = b""
    head += [f"Content-Length: {len(payload)}", "", ""]
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode()) + packer.compress(payload) + packer.compress(b"\r\n\r\n") + packer.flush()


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit: int = 1000, archive_bytes: int = 4_000_000) -> None:
    """Write archives of about ``archive_bytes`` compressed bytes under ``path``."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        size = 0
        pack = lambda: pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], names=["value"])
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append(build_record(*row))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield pack()
                    held, size = [], 0
        if held:
            yield pack()

    rows = with_revisits(pages, id_col, url_col, html_col, min_revisit)
    rows.mapInArrow(write, "value binary").select(F.col("value").cast("string")).write.option("maxRecordsPerFile", 1).option("lineSep", "\0").text(path)


def starts_record(piece: bytes) -> bool:
    """Whether a sound gzip header and the start of a WARC record lie here."""
    if piece[:3] != _MAGIC or len(piece) < 18 or piece[3] & 0xE0:
        return False
    try:
        return zlib.decompressobj(31).decompress(piece[:4096], 64).startswith(_VERSION)
    except zlib.error:
        return False


def whole_member(data: bytes) -> tuple[bytes, bytes] | None:
    """The decompressed member at the start of ``data`` and what follows it; the
    member is empty if it does not end there, and None stands for damage."""
    unpacker = zlib.decompressobj(31)
    try:
        out = unpacker.decompress(data) + unpacker.flush()
    except zlib.error:
        return None
    return (out, unpacker.unused_data) if unpacker.eof else (b"", data)


def parse_record(record: bytes) -> tuple:
    """A record's row, of the columns in ``_RECORD``."""
    head, _, body = record.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode("utf-8", "replace").split("\r\n")[1:] if ": " in x)
    number = lambda name: int(fields[name].rsplit(":", 1)[1].rstrip(">")) if name in fields else None
    payload = body[: int(fields.get("Content-Length", 0))]
    kind = fields.get("WARC-Type", "")
    size = int(fields.get("X-Payload-Length", len(payload)))
    return number("WARC-Record-ID"), fields.get("WARC-Target-URI"), payload if kind == "response" else None, size, fields.get("WARC-Payload-Digest", "").removeprefix("sha1:"), kind, number("WARC-Refers-To")


def members(data: bytes) -> Iterator[tuple[bytes | None, bytes]]:
    """(member or None, bytes) of joined pieces.

    A piece too short to tell what it is has been joined to the one before it: what
    follows a member's end is the next candidate.  Behind bytes that start no
    record or are damaged, the next candidate is the next magic that starts one.
    """
    while data:
        found = whole_member(data) if starts_record(data) else None
        if found and not found[0]:
            yield None, data  # its end lies in the next range
            return
        if found:
            at = data.find(_MAGIC, len(data) - len(found[1]))
            yield found[0], data[: at if at >= 0 else len(data)]
        else:
            at = data.find(_MAGIC, 1)
            while at >= 0 and not starts_record(data[at : at + 4096]):
                at = data.find(_MAGIC, at + 1)
            yield None, data[: at if at >= 0 else len(data)]
        data = data[at:] if at >= 0 else b""


def stitched(pieces: Iterator[bytes]) -> Iterator[tuple[bytes | None, bytes]]:
    """(member or None, bytes) of consecutive pieces: one that starts no record, or
    cannot yet be told to, is added to the one before it."""
    held: list[bytes] = []
    for piece in pieces:
        if held and starts_record(piece):
            yield from members(b"".join(held))
            held = []
        held.append(piece)
    yield from members(b"".join(held))


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Every record under ``path``: the columns of ``_RECORD``; revisits have no payload."""
    meta = F.col("_metadata")
    pieces = (
        spark.read.option("lineSep", _MAGIC.decode("latin-1")).option("encoding", "ISO-8859-1").text(path)
        .select(F.col("value").cast("binary").alias("piece"), meta["file_path"].alias("file"), meta["file_block_start"].alias("block"))
    )
    columns = f"{_RECORD}, piece binary, file string, block long, seq long"
    names = [c.strip().split(" ")[0] for c in columns.split(",")]

    def rows_of(found) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)], names=names)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each():
            for batch in batches:
                yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

        out, size = [], 0
        for (file, block), own in groupby(each(), key=lambda r: r[1:]):
            # What comes before a file's first magic has none before it.
            whole = (_MAGIC + r[0] if i or block else r[0] for i, r in enumerate(own))
            for seq, (member, data) in enumerate(stitched(whole)):
                if member is not None:
                    out.append((*parse_record(member), None, None, None, None))
                elif data.strip(b"\0"):
                    out.append((*[None] * 7, data, file, block, seq))
                size += len(member or data)
                if size > 4_000_000:
                    yield rows_of(out)
                    out, size = [], 0
        if out:
            yield rows_of(out)

    found = written(pieces.mapInArrow(read, columns))

    def join_over_ends(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["block", "seq"])
        rows = [parse_record(m) for m, _ in stitched(bytes(x) for x in group["piece"]) if m is not None]
        return pd.DataFrame(rows, columns=names[:7])

    whole = found.filter("piece is null").select(*names[:7])
    torn = found.filter("piece is not null").groupBy("file").applyInPandas(join_over_ends, _RECORD)
    return whole.unionByName(torn)
