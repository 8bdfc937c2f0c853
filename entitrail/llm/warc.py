"""WARC archives: writing pages as records, and reading them back with segments reassembled.

Writing. A page is a ``response`` record, an HTTP message with chunked transfer framing. Of pages with equal payloads of at
least ``least_revisit`` bytes, that with the largest page_id is the response and the others are ``revisit`` records
that name it. A message of more than ``segment`` bytes is cut: its first part is the response record, number 1, the
others are ``continuation`` records that name it as their origin; the last one states the total length. Records go to
archives of about ``archive`` bytes, so a page's segments may lie in different archives; each archive is one
gzip-compressed file written through Spark's committer.

Reading. An archive may be one gzip member, or one for each record, as is usual, or not compressed. It is inflated as a
stream and parsed once, record by record, by stated lengths; a file that ends within a member or a record is an error.
Whole records are decoded where they are read; segmented ones alone are grouped by origin identifier, ordered by segment
number, verified against the total length, joined and decoded. A group is one page's message. Payloads are verified
against the digest in the record, where it is a SHA-1.

Defined cases: a null html is an empty payload; a null url is left out; ``page_id`` may be null (never the largest) or
repeat: all rows with the largest page_id are responses, all others revisits, and a revisit never names a null; an
empty table gives no archives and no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import spread, table, work_dir, written
from .files import read_blobs, write_blobs

_DATE = "2024-01-01T00:00:00Z"
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_NAME = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
#: Pages of this many bytes and more are compared.
LEAST_REVISIT = 1000


def roles(pages: DataFrame, least_revisit: int = LEAST_REVISIT) -> DataFrame:
    """(page_id, url, html, digest, refers_to): what each row of (page_id, url, html) is written as.

    Only digests and ids are grouped, summed up before the shuffle; the table of groups of two or more is looked up, by
    broadcast where it is small and else by a join that splits hot digests.
    """
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = spread(pages.selectExpr("cast(page_id as long) page_id", "url", "html")).withColumn("digest", F.sha1(body)).withColumn("n_bytes", F.octet_length(body))
    groups = rows.where(F.col("n_bytes") >= least_revisit).groupBy("digest", "n_bytes").agg(F.max("page_id").alias("keep"), F.count("*").alias("n"))
    groups = written(groups.where("n > 1 and keep is not null").select("digest", "n_bytes", "keep"), "warc-groups")
    return rows.join(groups, ["digest", "n_bytes"], "left").selectExpr("page_id", "url", "html", "digest", "if(page_id <=> keep, null, keep) refers_to")


def page_urn(page_id: int) -> str:
    """What a page's response is called; with equal ids, of several responses with one content."""
    return uuid.uuid5(_NAME, f"page/{page_id}").urn


def _record(kind: str, identifier: str, headers: dict[str, str], block: bytes) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{identifier}>", f"WARC-Date: {_DATE}", *(f"{k}: {v}" for k, v in headers.items()), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def chunked(payload: bytes, size: int = 1 << 14) -> bytes:
    out = []
    for at in range(0, len(payload), size):
        part = payload[at : at + size]
        out += (b"%x\r\n" % len(part), part, b"\r\n")
    return b"".join([*out, b"0\r\n\r\n"])


def dechunked(framed: bytes) -> bytes:
    out, at = [], 0
    while True:
        end = framed.index(b"\r\n", at)
        size = int(framed[at:end].split(b";")[0], 16)
        if not size:
            return b"".join(out)
        out.append(framed[end + 2 : end + 2 + size])
        if framed[end + 2 + size : end + 4 + size] != b"\r\n":
            raise ValueError("a chunk does not end where its size says")
        at = end + 4 + size


def _digest(sha1_hex: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(sha1_hex)).decode()


def records(page_id: int | None, url: str | None, html: str | None, sha1_hex: str, refers_to: int | None, unique: str, segment: int) -> list[bytes]:
    """The records of a page, in order."""
    payload = (html or "").encode("utf-8", "surrogatepass")
    identifier = uuid.uuid5(_NAME, unique).urn
    headers = {} if url is None else {"WARC-Target-URI": re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m.group()):02X}", url)}
    headers |= {} if page_id is None else {"X-Page-ID": str(page_id), "X-Page-URN": page_urn(page_id)}
    headers |= {"WARC-Payload-Digest": _digest(sha1_hex)}
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    if refers_to is not None:
        headers |= {"WARC-Profile": _REVISIT, "WARC-Refers-To": f"<{page_urn(refers_to)}>", "X-Refers-To-Page": str(refers_to), "X-Payload-Length": str(len(payload)), "Content-Type": "application/http; msgtype=response"}
        return [_record("revisit", identifier, headers, http)]
    headers["Content-Type"] = "application/http; msgtype=response"
    block = http + chunked(payload)
    if len(block) <= segment:
        return [_record("response", identifier, headers, block)]
    parts = [block[at : at + segment] for at in range(0, len(block), segment)]
    out = [_record("response", identifier, headers | {"WARC-Segment-Number": "1"}, parts[0])]
    for n, part in enumerate(parts[1:], 2):
        more = {k: headers[k] for k in ("WARC-Target-URI",) if k in headers} | {"WARC-Segment-Origin-ID": f"<{identifier}>", "WARC-Segment-Number": str(n)}
        if n == len(parts):
            more["WARC-Segment-Total-Length"] = str(len(block))
        out.append(_record("continuation", uuid.uuid5(_NAME, f"{unique}/{n}").urn, more, part))
    return out


def write_archives(pages: DataFrame, path: str, segment: int = 1 << 16, archive: int = 1 << 23) -> None:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, row, held, size, number = TaskContext.get().partitionId(), 0, [], 0, 0

        def out() -> pa.RecordBatch:
            info = _record("warcinfo", uuid.uuid5(_NAME, f"info/{part}/{number}").urn, {"Content-Type": "application/warc-fields"}, b"format: WARC File Format 1.1\r\n")
            return pa.RecordBatch.from_arrays([pa.array([b"".join([info, *held])], pa.binary())], names=["content"])

        for batch in batches:
            for i in range(batch.num_rows):  # a row at a time, as pages may be long
                for record in records(*(c[i].as_py() for c in batch.columns), f"{part}/{row}", segment):
                    held.append(record)
                    size += len(record)
                    if size >= archive:
                        yield out()
                        held, size, number = [], 0, number + 1
                row += 1
        if held:
            yield out()

    write_blobs(roles(pages).select("page_id", "url", "html", "digest", "refers_to").mapInArrow(run, "content binary"), path, "gzip")


_RECORD = "kind string, id string, origin string, segment int, total long, page_id long, url string, digest string, refers_to long, length long, block binary"


class _Stream:
    """An archive's bytes, inflated as they are asked for, over all gzip members."""

    def __init__(self, content: bytes):
        self.left, self.zip = content, content[:2] == b"\x1f\x8b"
        self.data, self.at = bytearray(b"" if self.zip else content), 0
        self.member = zlib.decompressobj(31) if self.zip else None

    def more(self) -> bool:
        """Inflates a further part; False at the end."""
        if not self.zip:
            return False
        if self.member.eof:
            self.left = self.member.unused_data
            if not self.left.strip(b"\0"):
                return False
            self.member = zlib.decompressobj(31)
        elif not self.left:
            raise ValueError("the archive ends within a gzip member")
        part = self.member.decompress(self.left, 1 << 20)
        self.left = self.member.unconsumed_tail
        if not part and not self.left and not self.member.eof:
            raise ValueError("the archive ends within a gzip member")
        if self.at > 1 << 20:
            del self.data[: self.at]
            self.at = 0
        self.data += part
        return True

    def until(self, mark: bytes) -> bytes | None:
        """What comes before ``mark``, which is passed; None if nothing is left at all."""
        seen = self.at
        while (end := self.data.find(mark, seen)) < 0:
            back = len(self.data) - self.at
            if not self.more():
                if back == 0:
                    return None
                raise ValueError("the archive ends within a record's head")
            seen = max(self.at, self.at + back - len(mark))
        found = bytes(self.data[self.at : end])
        self.at = end + len(mark)
        return found

    def take(self, n: int) -> bytes:
        while len(self.data) - self.at < n:
            if not self.more():
                raise ValueError("the archive ends within a record")
        found = bytes(self.data[self.at : self.at + n])
        self.at += n
        return found


def _sha1_hex(value: str | None) -> str | None:
    """A SHA-1 in hex, from Base32 or hex; other algorithms are not verified."""
    if not value or not value.lower().startswith("sha1:"):
        return None
    value = value[5:]
    return value.lower() if len(value) == 40 else base64.b32decode(value.upper()).hex()


def _parsed(content: bytes) -> Iterator[dict]:
    """The records of an archive; a response's message may be a first segment."""
    stream = _Stream(content)
    while (head := stream.until(b"\r\n\r\n")) is not None:
        version, *lines = head.decode("utf-8", "replace").split("\r\n")
        if not version.startswith("WARC/1."):
            raise ValueError(f"not a record: {version[:40]!r}")
        h = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        number = lambda key: int(h[key]) if key in h else None
        block = stream.take(int(h["content-length"]))
        if stream.take(4) != b"\r\n\r\n":
            raise ValueError("a record does not end where its length says")
        yield {"kind": h["warc-type"], "id": h["warc-record-id"], "origin": h.get("warc-segment-origin-id"), "segment": number("warc-segment-number"), "total": number("warc-segment-total-length"), "page_id": number("x-page-id"), "url": h.get("warc-target-uri"), "digest": _sha1_hex(h.get("warc-payload-digest")), "refers_to": number("x-refers-to-page"), "length": number("x-payload-length"), "block": block}


def payload_of(message: bytes) -> bytes:
    head, _, body = message.partition(b"\r\n\r\n")
    return dechunked(body) if b"transfer-encoding: chunked" in head.lower() else body


_PAGE = "page_id long, url string, record_type string, refers_to long, digest string, length long, payload binary"
_FIELDS = [x.split()[0] for x in _PAGE.split(", ")]
_KINDS = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]


def _page(r: dict, message: bytes) -> dict:
    page = {"page_id": r["page_id"], "url": r["url"], "record_type": r["kind"], "refers_to": r["refers_to"], "digest": r["digest"], "length": r["length"], "payload": None}
    if r["kind"] == "response":
        page["payload"] = payload_of(message)
        page["length"] = len(page["payload"])
        if r["digest"] is not None and hashlib.sha1(page["payload"]).hexdigest() != r["digest"]:
            raise ValueError(f"the payload of {r['id']} does not have its digest")
    return page


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[f] for r in rows], kind) for f, kind in zip(_FIELDS, _KINDS)], names=_FIELDS)


def _reassembled(rows: pa.Table) -> pa.Table:
    """One origin's segments: ordered, verified, joined and decoded."""
    parts = sorted(rows.to_pylist(), key=lambda r: r["segment"])
    message = b"".join(r["block"] for r in parts)
    if [r["segment"] for r in parts] != list(range(1, len(parts) + 1)) or parts[-1]["total"] != len(message):
        raise ValueError(f"the segments of {parts[0]['id']} are not whole")
    return pa.Table.from_batches([_batch([_page(parts[0], message)])])


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, url, record_type, refers_to, digest, length, payload): a row per page, payload null for revisits.

    Archives are parsed once, into a written table of pages and, with their blocks, segments.
    """
    names = [x.split()[0] for x in _RECORD.split(", ")]
    kinds = [{"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[x.split()[1]] for x in _RECORD.split(", ")]
    none = dict.fromkeys(_FIELDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[tuple[dict, dict | None]]) -> pa.RecordBatch:
            pages, cut = _batch([page for page, _ in rows]), [r for _, r in rows]
            struct = pa.StructArray.from_arrays([pa.array([r and r[f] for r in cut], kind) for f, kind in zip(names, kinds)], names=names, mask=pa.array([r is None for r in cut]))
            return pa.RecordBatch.from_arrays([*pages.columns, struct], names=[*_FIELDS, "cut"])

        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for r in _parsed(content.as_py()):
                    if r["segment"] is not None:
                        rows.append((none, r))
                    elif r["kind"] in ("response", "revisit"):
                        rows.append((_page(r, r["block"]), None))
                    size += len(r["block"])
                    if len(rows) >= 1000 or size > 1 << 23:
                        yield out(rows)
                        rows, size = [], 0
                if rows:
                    yield out(rows)

    cut_type = "struct<" + ",".join(":".join(x.split()) for x in _RECORD.split(", ")) + ">"
    found = written(read_blobs(spark, path).mapInArrow(run, f"{_PAGE}, cut {cut_type}"), "warc-read")
    segments = found.where("cut is not null").select("cut.*").withColumn("origin", F.coalesce("origin", "id"))
    return found.where("cut is null").drop("cut").unionByName(segments.groupBy("origin").applyInArrow(_reassembled, _PAGE))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_dir(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    found = read_archives(spark, path)
    digest = F.coalesce(F.sha1("payload"), F.col("digest"))
    return found.select("page_id", F.coalesce(F.octet_length("payload").cast("long"), F.col("length")).alias("payload_bytes"), digest.alias("payload_digest"), "record_type", "refers_to")


OP9_SQL = f"""
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), g AS (
  SELECT *, CASE WHEN payload_bytes >= {LEAST_REVISIT} THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) END AS keep FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN keep <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN keep <> page_id THEN keep END AS refers_to
FROM g
"""
