"""WARC archives: written by Spark, read back, and put together from segments.

Records are written as text files with the record separator as line separator, gzip-compressed, so Spark's own commit
protocol covers lost executors. A response holds an HTTP message in chunked transfer framing; a message longer than a
segment continues in further records. Reading groups continuation records by origin identifier, orders them by segment
number, verifies the total length, and decodes the framing. Equal payloads of at least `LEAST` bytes are kept once: the
smallest page id is the response, the others are revisits that name it.

Edge cases: a null page counts as empty; repeated rows of a page are each a record; records that miss a segment, or whose
length or digest differs, are reported as not valid; line breaks in an address are dropped; an empty table writes and reads nothing.
Damaged archives stop nothing: where an archive or a record ends early, a member is broken or a header says no length, a record with a problem tells the
file and the place in what was unpacked, and reading goes on at the next record or member. Archives are unpacked piece by piece; packed, each is in memory once.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.session import bounded_batches, scratch_folder

LEAST, CHUNK, SEGMENT, PER_FILE = 100, 4096, 16384, 2000
_SEPARATOR = "\r\n\r\n"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
RECORDS = "type string, record_id string, origin string, number int, total long, digest string, refers_to string, block binary, offset long, problem string"
#: A header of more bytes is none.
LONGEST_HEAD = 1 << 20
_GZIP = b"\x1f\x8b\x08"


def revisits(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """(page_id, refers_to) of pages whose payload a smaller page id has too."""
    told = pages.select("page_id", F.sha2("html", 256).alias("digest"), F.octet_length("html").alias("size")).where((F.col("size") >= least) & F.col("page_id").isNotNull())
    first = told.groupBy("digest", "size").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last")).where("last > refers_to").drop("last")
    return told.join(first, ["digest", "size"]).where("page_id > refers_to").select("page_id", "refers_to").distinct()


def chunked(payload: str, size: int = CHUNK) -> str:
    """A payload in chunks; sizes are bytes, cuts fall between characters."""
    parts = [payload[i : i + size] for i in range(0, len(payload), size)]
    return "".join(f"{len(p.encode()):x}\r\n{p}\r\n" for p in parts) + "0\r\n\r\n"


def dechunked(body: bytes) -> bytes:
    """Decode chunked framing; chunk extensions and trailers are skipped. Raises ValueError on broken framing."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        n = int(body[at:end].split(b";")[0], 16)
        if not n:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + n])
        at = end + 2 + n
        if len(out[-1]) != n or body[at : at + 2] != b"\r\n":
            raise ValueError("a chunk ends early")
        at += 2


def _record(fields: dict[str, object], block: str) -> str:
    head = "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None)
    return f"WARC/1.1\r\n{head}Content-Length: {len(block.encode())}\r\n\r\n{block}"


def written(page_id: object, number: int, url: str | None, html: str | None, refers_to: int | None, segment: int = SEGMENT) -> list[str]:
    """The records of a page."""
    payload = html or ""
    digest = f"sha256:{hashlib.sha256(payload.encode()).hexdigest()}"
    me = f"<urn:x-page:{'' if page_id is None else page_id}:{number}>"
    common = {"WARC-Target-URI": re.sub(r"[\r\n]", "", url or ""), "WARC-Date": "2024-01-01T00:00:00Z"}
    if refers_to is not None:
        profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        return [_record({"WARC-Type": "revisit", "WARC-Record-ID": me} | common | {"WARC-Profile": profile, "WARC-Refers-To": f"<urn:x-page:{refers_to}>", "WARC-Payload-Digest": digest}, "")]
    block = _HTTP + chunked(payload)
    parts = [block[i : i + segment] for i in range(0, len(block), segment)]
    first = {"WARC-Type": "response", "WARC-Record-ID": me} | common | {"Content-Type": "application/http;msgtype=response", "WARC-Payload-Digest": digest}
    if len(parts) == 1:
        return [_record(first, block)]
    out = [_record(first | {"WARC-Segment-Number": 1}, parts[0])]
    for k, part in enumerate(parts[1:], 2):
        last = len(block.encode()) if k == len(parts) else None
        out.append(_record({"WARC-Type": "continuation", "WARC-Record-ID": f"{me[:-1]}:{k}>", "WARC-Segment-Origin-ID": me, "WARC-Segment-Number": k, "WARC-Segment-Total-Length": last}, part))
    return out


def write(pages: DataFrame, path: str, least: int = LEAST) -> None:
    """Archives of pages (page_id, url, html) in a folder that Spark can write to."""
    again = revisits(pages, least).withColumnRenamed("page_id", "__page")
    rows = pages.select("page_id", "url", "html").join(again, F.col("page_id") == F.col("__page"), "left").select("page_id", "url", F.when(F.col("refers_to").isNull(), F.col("html")).alias("html"), F.when(F.col("refers_to").isNotNull(), F.sha2("html", 256)).alias("digest"), "refers_to", F.monotonically_increasing_id().alias("number"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b.astype(object).where(b.notna(), None)
            out = []
            for p, n, u, h, d, r in zip(b["page_id"], b["number"], b["url"], b["html"], b["digest"], b["refers_to"], strict=True):
                made = written(None if p is None else int(p), n, u, h, None if r is None else int(r))
                out += [x.replace(_EMPTY, f"sha256:{d}", 1) for x in made] if d else made
            yield pd.DataFrame({"value": out})

    text = rows.mapInPandas(run, "value string")
    text.write.option("lineSep", _SEPARATOR).option("compression", "gzip").option("maxRecordsPerFile", PER_FILE).text(path)


_EMPTY = f"sha256:{hashlib.sha256(b'').hexdigest()}"


def unpacked(data: bytes, size: int = 1 << 18) -> Iterator[tuple[bytes, str | None]]:
    """What an archive holds in pieces, gzip members one after the other; (b"", problem) where a member can't be read on, and then what follows it."""
    if data[:2] != _GZIP[:2]:
        yield from ((data[i : i + size], None) for i in range(0, len(data), size))
        return
    at, view = 0, memoryview(data)
    while at >= 0 and at < len(data):
        z, start = zlib.decompressobj(31), at
        try:
            while not z.eof and at < len(data):
                piece = view[at : at + size]
                out = z.decompress(piece)
                at += len(piece) - len(z.unused_data)
                if out:
                    yield out, None
            if not z.eof:
                yield b"", "the archive ends within a member"
            elif data[at : at + 3] != _GZIP:
                at = data.find(_GZIP, at)
        except zlib.error:
            yield b"", "a member is broken"
            at = data.find(_GZIP, start + 1)


def parse(data: bytes) -> Iterator[tuple]:
    """The records of an archive, as RECORDS, and what can't be read as records with a problem."""
    source, buffer, base, stop = unpacked(data), bytearray(), 0, None

    def fill() -> bool:
        """One more piece, unless the archive is over or its next piece can't be read."""
        nonlocal stop
        if stop is None:
            piece, problem = next(source, (b"", "over"))
            stop = problem
            buffer.extend(piece)
        return stop is None

    def broken(problem: str, head: dict | None = None) -> tuple:
        head = head or {}
        return (head.get("warc-type"), head.get("warc-record-id"), None, None, None, None, None, None, base, problem)

    def skip(n: int) -> None:
        nonlocal base
        del buffer[:n]
        base += n

    while True:
        while (i := buffer.find(b"WARC/")) < 0:
            skip(max(0, len(buffer) - 4))
            if not fill():
                break
        if i < 0:
            if stop == "over":
                return
            yield broken(stop)
            skip(len(buffer))
            stop = None
            continue
        skip(i)
        while (end := buffer.find(b"\r\n\r\n")) < 0 and len(buffer) < LONGEST_HEAD and fill():
            pass
        if end < 0:
            yield broken("a header does not end")
            skip(5)
            continue
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in buffer[:end].decode(errors="replace").split("\r\n")[1:])}
        n, number, total = (head.get(k) for k in ("content-length", "warc-segment-number", "warc-segment-total-length"))
        if not (n or "").isdigit() or not all(x is None or x.isdigit() for x in (number, total)):
            yield broken("a header has no length, or a number that is none", head)
            skip(end + 4)
            continue
        size = end + 4 + int(n)
        while len(buffer) < size and fill():
            pass
        if len(buffer) < size:
            yield broken("a record ends early", head)
            skip(len(buffer))
            if stop == "over":
                return
            stop = None
            continue
        yield (
            head.get("warc-type"), head.get("warc-record-id"), head.get("warc-segment-origin-id"), number and int(number),
            total and int(total), head.get("warc-payload-digest"), head.get("warc-refers-to"), bytes(buffer[end + 4 : size]), base, None,
        )
        skip(size)


def read(spark: SparkSession, path: str) -> DataFrame:
    """All records of the archives in a folder: file and RECORDS."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in RECORDS.split(", ")]

        def frame(name: str, rows: list[tuple]) -> pd.DataFrame:
            out = pd.DataFrame(rows, columns=columns).astype({"number": "Int32", "total": "Int64"})
            out.insert(0, "file", name)
            return out

        for b in batches:
            for name, data in zip(b["path"], b["content"], strict=True):
                rows, size = [], 0
                for r in parse(bytes(data)):
                    rows.append(r)
                    size += len(r[7] or b"")
                    if size > 1 << 23:
                        yield frame(name, rows)
                        rows, size = [], 0
                yield frame(name, rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return files.select("path", "content").mapInPandas(run, f"file string, {RECORDS}")


def damaged(records: DataFrame) -> DataFrame:
    """file, offset, record_id (where it is known) and problem of what could not be read."""
    return records.where("problem is not null").select("file", "offset", "record_id", "problem")


def reassembled(records: DataFrame) -> DataFrame:
    """One row for each record that is not a continuation: its whole block, null where a segment or the length is wrong."""
    kept = ["type", "record_id", "digest", "refers_to"]
    records = records.where("problem is null")
    whole = records.where(F.col("number").isNull() & F.col("origin").isNull()).select(*kept, "block")
    part = records.where(F.col("number").isNotNull())
    by = part.groupBy(F.coalesce("origin", "record_id").alias("origin")).agg(
        F.expr("listagg(block) within group (order by number)").alias("block"),
        F.count("*").alias("n"),
        F.size(F.collect_set("number")).alias("numbers"),
        F.min("number").alias("low"),
        F.max("number").alias("high"),
        F.max("total").alias("total"),
        *[F.max(F.when(F.col("number") == 1, F.col(c))).alias(c) for c in kept],
    )
    numbered = (F.col("low") == 1) & (F.col("high") == F.col("n")) & (F.col("numbers") == F.col("n"))
    joined = by.where(F.col("record_id").isNotNull())
    good = numbered & (F.octet_length("block") == F.col("total"))
    return whole.unionByName(joined.select(*kept, F.when(good, F.col("block")).alias("block")))


def payloads(whole: DataFrame) -> DataFrame:
    """type, record_id, refers_to, named (the digest that a record names), payload_bytes, payload_digest, valid: of responses from the decoded block, of others null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for kind, rid, digest, refers, block in zip(b["type"], b["record_id"], b["digest"], b["refers_to"], b["block"], strict=True):
                size = got = None
                if kind == "response" and block is not None:
                    head, _, body = bytes(block).partition(b"\r\n\r\n")
                    try:
                        body = dechunked(body) if b"transfer-encoding: chunked" in head.lower() else body
                        size, got = len(body), hashlib.sha256(body).hexdigest()
                    except ValueError:
                        pass
                rows.append((kind, rid, refers, digest, size, got, kind != "response" or f"sha256:{got}" == digest))
            yield pd.DataFrame(rows, columns=["type", "record_id", "refers_to", "named", "payload_bytes", "payload_digest", "valid"]).astype({"payload_bytes": "Int64"})

    return whole.mapInPandas(run, "type string, record_id string, refers_to string, named string, payload_bytes long, payload_digest string, valid boolean")


def round_trip(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Write archives into the shared folder and read them back: page_id, payload_bytes, payload_digest, record_type, refers_to, valid."""
    spark = pages.sparkSession
    bounded_batches(spark)
    path = scratch_folder(spark, "warc")
    write(pages, path, least)
    number = lambda c: F.nullif(F.regexp_extract(c, r"^<urn:x-page:(-?\d*)", 1), F.lit("")).cast("long")
    got = payloads(reassembled(read(spark, path))).select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), number("refers_to").alias("refers_to"), "named", "valid")
    first = got.where("record_type = 'response'").select(F.col("page_id").alias("__first"), F.col("payload_bytes").alias("__bytes"), F.col("payload_digest").alias("__digest")).distinct()
    # A page may have several records: the digest that a revisit names tells which of them it repeats.
    seen = got.where("record_type = 'revisit'").join(first, (F.col("refers_to") == F.col("__first")) & (F.col("named") == F.concat(F.lit("sha256:"), "__digest")), "left")
    seen = seen.select("page_id", F.col("__bytes").alias("payload_bytes"), F.col("__digest").alias("payload_digest"), "record_type", "refers_to", (F.col("valid") & F.col("__digest").isNotNull()).alias("valid"))
    return got.where("record_type = 'response'").drop("named").unionByName(seen)
