"""WARC archives: a writer with revisit records and a salvage reader.

Archives are byte strings of gzip members, one record each, kept as rows (name, content)
so that Spark's own commit protocol stores them in any file system; files that
``spark.read.format("binaryFile")`` reads have the same two columns (path, content).

The salvage reader never gives up on an archive: after a failed check (gzip CRC, version
line, header, length, block digest) it searches for the next place where a valid gzip
member or a ``WARC/1.`` line begins, goes on from there, and logs the gap of bytes that it
skipped. It searches inside members too: one bad record of a member doesn't cost the others,
and what a damaged member still yields is read as far as it goes.

Records carry all fields that the format asks for. A record's id is derived from its page and
payload and the date is a parameter, so a task that runs again writes the same bytes.

Defined edge cases: a null html is the empty payload; a null page_id is larger than every
other, so its record revisits a page with an id where there is one; a repeated row is
written twice, and both copies of the smallest page_id are responses; an empty table makes
no archive; a null url is written as ``urn:none``; very long pages are one record each. A
record that is lost or fails its checks in round_trip() makes digest() fail.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stored

VERSION = b"WARC/1.1\r\n"
ARCHIVE_BYTES = 4 << 20
#: When the pages were taken, for tables that don't say.
DATE = "2000-01-01T00:00:00Z"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_NEXT = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r?\n")
_VERSION = re.compile(rb"WARC/1\.[01]\r?\n")
_END = re.compile(rb"\r?\n\r?\n")
_LINE = re.compile(rb"([!#$%&'*+.^_`|~0-9A-Za-z-]+):[ \t]*(.*)")


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None, digest: str, revisit: bool) -> str:
    """A URN that page, payload and kind determine."""
    return f"<{uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id}/{digest}/{revisit}').urn}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None, revisit: bool = False, date: str = DATE) -> bytes:
    """One record, uncompressed. A revisit has the payload's digest and length, not the payload."""
    block = _HTTP if revisit else _HTTP + payload
    digest = base32_sha1(payload)
    heads = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", record_id(page_id, digest, revisit)),
        ("WARC-Date", date),
        ("WARC-Target-URI", quote(url, safe="%/:=&?~#+!$,;'@()*[]") if url else "urn:none"),
        ("WARC-Payload-Digest", "sha1:" + digest),
        ("WARC-Block-Digest", "sha1:" + base32_sha1(block)),
        ("Content-Type", "application/http; msgtype=response"),
        ("X-Payload-Length", str(len(payload))),
        ("X-Page-Id", "" if page_id is None else str(page_id)),
    ]
    if revisit:
        heads += [("WARC-Refers-To", record_id(refers_to, digest, False)), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("X-Refers-To-Page-Id", "" if refers_to is None else str(refers_to))]
    heads.append(("Content-Length", str(len(block))))
    return VERSION + "".join(f"{k}: {v}\r\n" for k, v in heads).encode() + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 3) -> bytes:
    """data as one gzip member without a time stamp, so that equal records are equal bytes."""
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


@dataclass
class Salvaged:
    """What a reading of one archive found."""

    records: list[tuple[int, dict[str, str], bytes]] = field(default_factory=list)  # offset, headers, block
    gaps: list[tuple[int, int, str]] = field(default_factory=list)  # offset, length, reason


def parse_record(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers, block and end of the record at ``at``; ValueError names the check that failed."""
    m = _VERSION.match(data, at)
    if not m:
        raise ValueError("version line")
    heads, pos = {}, m.end()
    while True:
        end = data.find(b"\n", pos)
        if end < 0:
            raise ValueError("truncated header")
        line, pos = data[pos:end].rstrip(b"\r"), end + 1
        if not line:
            break
        if not (m := _LINE.fullmatch(line)):
            raise ValueError("header line")
        heads[m[1].decode().lower()] = m[2].decode("utf-8", "replace")
    if not heads.get("content-length", "").isdigit():
        raise ValueError("content length")
    end = pos + int(heads["content-length"])
    block = data[pos:end]
    if len(block) < end - pos:
        raise ValueError("truncated block")
    digest = heads.get("warc-block-digest", "")
    if digest.startswith("sha1:") and digest[5:] != base32_sha1(block):
        raise ValueError("block digest")
    tail = _END.match(data, end)
    if not tail:
        raise ValueError("record end")
    return heads, block, tail.end()


def _member_at(data: bytes, at: int) -> tuple[bytes, int, str]:
    """What a gzip member holds, as far as it can be read; its end; what is wrong with it."""
    z, out, pos = zlib.decompressobj(31), [], at
    try:
        while not z.eof and pos < len(data):
            out.append(z.decompress(data[pos : pos + 65536]))
            pos += 65536
    except zlib.error as e:
        return b"".join(out), at, "gzip: " + str(e).split(":")[0]
    if not z.eof:
        return b"".join(out), at, "truncated member"
    return b"".join(out), min(pos, len(data)) - len(z.unused_data), ""


def _plain_records(data: bytes) -> tuple[list[tuple[dict[str, str], bytes]], list[tuple[int, int, str]]]:
    """The valid records of decompressed data and the gaps (offset, length, reason) between them."""
    records, gaps, at = [], [], 0
    while at < len(data):
        try:
            heads, block, at = parse_record(data, at)
            records.append((heads, block))
        except ValueError as e:
            m = _VERSION.search(data, at + 1)
            end = m.start() if m else len(data)
            if gaps and gaps[-1][0] + gaps[-1][1] == at:
                gaps[-1] = (gaps[-1][0], end - gaps[-1][0], gaps[-1][2])
            else:
                gaps.append((at, end - at, str(e)))
            at = end
    return records, gaps


def salvage(data: bytes) -> Salvaged:
    """Every valid record of an archive, gzipped or plain or mixed, and the gaps between them.

    A gap inside a sound member has the member's offset, its own decompressed length, and its
    place in the reason.
    """
    found, at, gap, why = Salvaged(), 0, None, ""
    while at < len(data):
        records, inner = [], []
        if data[at : at + 2] == b"\x1f\x8b":
            plain, end, wrong = _member_at(data, at)
            records, inner = _plain_records(plain)
            if not wrong and not records:
                wrong = inner[0][2] if inner else "empty member"
        else:
            try:
                heads, block, end = parse_record(data, at)
                records, wrong = [(heads, block)], ""
            except ValueError as e:
                wrong = str(e)
        # Records of a damaged member have passed their own checks.
        found.records += [(at, heads, block) for heads, block in records]
        if wrong:
            if gap is None:
                gap, why = at, wrong
            m = _NEXT.search(data, at + 1)
            at = m.start() if m else len(data)
            continue
        if gap is not None:
            found.gaps.append((gap, at - gap, why))
            gap = None
        found.gaps += [(at, n, f"{reason}, at {k} of the member") for k, n, reason in inner]
        at = end
    if gap is not None:
        found.gaps.append((gap, len(data) - gap, why))
    return found


def with_digest(pages: DataFrame) -> DataFrame:
    """page_id, url, html (null: empty) and its SHA-1 as 20 bytes, all in the JVM."""
    html = F.coalesce(F.col("html"), F.lit(""))
    return pages.select("page_id", "url", html.alias("html"), F.unhex(F.sha1(F.encode(html, "UTF-8"))).alias("sha1"))


def _archives(archive_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, n = [], 0, 0

        def flush():
            content = b"".join(held)
            name = hashlib.sha1(content).hexdigest()[:20] + ".warc.gz"
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(held)], pa.int64()), pa.array([content], pa.binary())], ["path", "n_records", "content"])

        for batch in batches:
            for page, url, html, first in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "first")), strict=True):
                held.append(member(record(page, url, html.encode("utf-8", "surrogatepass"), first, revisit=page != first)))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return run


def write_archives(pages: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """(path, n_records, content): archives of one record a page.

    The first page of each payload comes from a pre-aggregated groupBy. Only digests and ids
    are shuffled for it; the join back is by digest, and AQE splits the payload that a third
    of all pages have.
    """
    rows = with_digest(pages)
    firsts = rows.groupBy("sha1").agg(F.min("page_id").alias("first")).withColumnRenamed("sha1", "of")
    joined = rows.join(firsts, F.col("sha1") == F.col("of")).select("page_id", "url", "html", "first")
    return joined.mapInArrow(_archives(archive_bytes), "path string, n_records long, content binary")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    # Headers of other writers may have anything there: such a value is none.
    number = lambda x: int(x) if x and re.fullmatch(r"-?[0-9]{1,18}", x.strip()) else None
    for batch in batches:
        expected = dict(zip(*(batch.column(c).to_pylist() for c in ("path", "n_records")), strict=True))
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
            rows = {k: [] for k in ("path", "offset", "kind", "page_id", "url", "payload", "payload_bytes", "payload_digest", "refers_to", "gap_bytes", "reason")}

            def put(*values, rows=rows):
                for k, v in zip(rows, values, strict=True):
                    rows[k].append(v)

            found = salvage(content or b"")
            missing = (expected.get(path) or 0) - len(found.records)
            for at, heads, block in found.records:
                kind = heads.get("warc-type")
                body = block.partition(b"\r\n\r\n")[2] if kind == "response" else None
                digest = heads.get("warc-payload-digest", "").removeprefix("sha1:")
                if body is not None and digest and digest != base32_sha1(body):
                    put(path, at, "gap", None, None, None, None, None, None, len(block), "payload digest")
                    continue
                size = len(body) if body is not None else number(heads.get("x-payload-length"))
                put(path, at, kind, number(heads.get("x-page-id")), heads.get("warc-target-uri"), body, size, digest, number(heads.get("x-refers-to-page-id")), None, None)
            for at, n, why in found.gaps:
                put(path, at, "gap", None, None, None, None, None, None, n, why)
            if missing > 0:
                put(path, None, "gap", None, None, None, None, None, None, None, f"{missing} records are missing")
            kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows.values(), kinds, strict=True)], list(rows))


def read_archives(archives: DataFrame) -> DataFrame:
    """Records and quarantined gaps (kind ``gap``) of archives with columns path and content.

    Where there is a column n_records, an archive with fewer gets a gap row that says so.
    """
    n_records = F.col("n_records") if "n_records" in archives.columns else F.lit(None).cast("long")
    return archives.select("path", "content", n_records.alias("n_records")).mapInArrow(_read, "path string, offset long, kind string, page_id long, url string, payload binary, payload_bytes long, payload_digest string, refers_to long, gap_bytes long, reason string")


def round_trip(pages: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write the archives of pages to the shared folder and read every record back."""
    return read_archives(stored(write_archives(pages, archive_bytes), "warc"))


def digest(records: DataFrame) -> DataFrame:
    """The contract's columns of round_trip(); a gap is an error here, as pages would be missing."""
    lost = F.concat_ws(" ", F.lit("archive"), "path", F.lit("lost records:"), "reason")
    kind = F.when(F.col("kind") == "gap", F.raise_error(lost).cast("string")).otherwise(F.col("kind"))
    return records.withColumn("kind", kind).select("page_id", "payload_bytes", "payload_digest", F.col("kind").alias("record_type"), F.when(F.col("kind") == "revisit", F.col("refers_to")).alias("refers_to"))


#: DuckDB has no base-32 encoder: five hex digits are four base-32 digits.
ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, upper(sha1(coalesce(html, ''))) AS h FROM pages),
f AS (SELECT h, min(page_id) AS first FROM p GROUP BY h),
b AS (SELECT h, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((('0x' || substr(h, 1 + 5 * (k // 4), 5))::BIGINT >> (15 - 5 * (k % 4))) & 31 AS INTEGER), 1), '' ORDER BY k) AS d FROM f, range(32) AS t(k) GROUP BY h)
SELECT p.page_id, CAST(octet_length(encode(p.html)) AS BIGINT) AS payload_bytes, b.d AS payload_digest,
       CASE WHEN p.page_id IS DISTINCT FROM f.first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN p.page_id IS DISTINCT FROM f.first THEN f.first END AS refers_to
FROM p JOIN f ON p.h = f.h JOIN b ON p.h = b.h
"""
