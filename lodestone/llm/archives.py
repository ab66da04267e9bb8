"""Web archives: legacy ARC files are parsed and converted to WARC, written, and read back."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import forget_at_exit, shared_dir
from .common import narrow, table, written

#: Bytes of records that a written archive holds by default, if no single record is longer.
ARCHIVE = 32 << 20
#: Groups of equal payloads up to which they are sent to the records.
SENT = 200_000
#: When pages without a time were fetched, and where from.
DATE, ADDRESS = "20240101000000", "0.0.0.0"
#: The fields of a record's header line, by version of the format.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length".split(),
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length".split(),
}
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_RECORD = "archive string, at long, record_id string, kind string, uri string, date string, ip string, content_type string, head binary, payload binary, payload_sha1 string, block_sha1 string, payload_sha256 string, problem string"
_READ = "archive string, at long, fields map<string,string>, block binary, problem string"


def sha1_of(*parts: bytes) -> str:
    """Base32 SHA-1, upper case."""
    sha = hashlib.sha1()
    for p in parts:
        sha.update(p)
    return base64.b32encode(sha.digest()).decode()


def unpacked(data: bytes) -> bytes:
    """data, or what its gzip members hold; a member that breaks off gives what can be read of it."""
    if data[:2] != b"\x1f\x8b":
        return data
    out = []
    while data[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        try:
            out += [member.decompress(data), member.flush()]
        except zlib.error:
            out.append(_salvaged(data))
            break
        data = member.unused_data
    return b"".join(out)


def _salvaged(data: bytes) -> bytes:
    member, out = zlib.decompressobj(31), []
    try:
        for k in range(0, len(data), 4096):
            out.append(member.decompress(data[k : k + 4096]))
    except zlib.error:
        pass
    return b"".join(out)


def clean_uri(uri: str | None, key: object) -> str:
    """A URI that fits a header line and isn't taken for an archive's own: spaces, control characters and
    the sign of such a scheme are escaped; a row without one gets a name by its key."""
    if not uri or not uri.strip():
        return f"urn:row:{key}"
    if uri.startswith("filedesc:"):
        uri = uri.replace(":", "%3A", 1)
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", uri)


# ---- writing ARC


def arc_file(name: str, records: list[tuple[str, bytes]], version: int, date: str = DATE) -> bytes:
    """An archive of (uri, document) in the legacy format, without the line feed after the last one."""
    said = f"{version} 0 Lodestone\n{' '.join(ARC_FIELDS[version])}\n"

    def line(uri: str, kind: str, length: int) -> bytes:
        more = [] if version == 1 else ["200", "-", "-", "0", name]
        return f"{uri} {ADDRESS} {date} {kind} {' '.join([*more, str(length)])}\n".encode()

    parts = [line(f"filedesc://{name}", "text/plain", len(said)) + said.encode()]
    parts += [line(uri, "text/html", len(doc)) + doc for uri, doc in records]
    return b"\n".join(parts)


def page_document(key: object, html: bytes) -> bytes:
    """A page as it was fetched: status line, header with the row's key, and the html."""
    named = "" if key is None else str(key)
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Row: {named}\r\nContent-Length: {len(html)}\r\n\r\n".encode() + html


def _as_arc(size: int):  # noqa: ANN202
    """(page_id, url, html) to archives of some size bytes, of both versions in turn."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, held, have = TaskContext.get().partitionId(), 0, [], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([arc_file(f"pages-{part:05d}-{n:05d}.arc", held, 1 + n % 2)], pa.binary())], ["value"])

        for b in batches:
            for key, url, html in zip(*(c.to_pylist() for c in b.columns), strict=True):
                doc = page_document(key, (html or "").encode())
                if held and have + len(doc) > size:
                    yield out()
                    n, held, have = n + 1, [], 0
                held.append((clean_uri(url, key), doc))
                have += len(doc)
        if held:
            yield out()

    return made


def _stored_as(archives: DataFrame, path: str, separator: str) -> None:
    """Writes each value(binary) as a gzip file of its own, the separator behind it."""
    text = archives.select(F.col("value").cast("string").alias("value"))
    # most of the work is packing: the fastest level takes half the time of the usual one
    text.write.options(lineSep=separator, compression="gzip", maxRecordsPerFile=1, **{"zlib.compress.level": "BEST_SPEED"}).text(path)


def write_arc(pages: DataFrame, path: str, size: int = ARCHIVE) -> None:
    """pages(page_id, url, html) as ARC files of some size bytes, versions 1 and 2 in turn."""
    _stored_as(narrow(pages, "page_id", "url", "html").mapInArrow(_as_arc(size), "value binary"), path, "\n")


# ---- reading ARC

_VERSION = re.compile(rb"(\d+) \d+ [^\n]*\n")


def _header(line: bytes, version: int) -> dict[str, str] | None:
    """The fields of a header line, from the right, as legacy URLs may hold spaces; None if it is none."""
    names = ARC_FIELDS[version]
    parts = line.decode("utf-8", "replace").rstrip("\r\n").rsplit(" ", len(names) - 1)
    if len(parts) != len(names) or not parts[-1].isdigit() or not re.fullmatch(r"\d{8,14}", parts[2]):
        return None
    return dict(zip(names, parts, strict=True))


def arc_records(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes, str | None]]:
    """(place, fields, document, problem) of the records of an archive.

    The version stands in the first record, whose document says so; each later header line is read by
    that version's fields, and its declared length alone tells where the document ends. Where no header
    line stands, the reading goes on at the next line that is one, and tells so; a document that the
    archive's end cuts off is told as such."""
    at, version, problem = 0, 1, None
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        end = data.find(b"\n", at)
        end = len(data) if end < 0 else end
        line = data[at:end]
        fields = None
        if line.startswith(b"filedesc://"):
            said = _VERSION.match(data, end + 1)
            version = int(said[1]) if said and int(said[1]) in ARC_FIELDS else version
            fields = _header(line, version) or _header(line, 3 - version)
        else:
            fields = _header(line, version)
        if fields is None:
            problem, at = f"no header line at {at}" if problem is None else problem, end + 1
            continue
        n = int(fields["Archive-length"])
        document = data[end + 1 : end + 1 + n]
        cut = None if len(document) == n else f"{len(document)} of {n} bytes"
        yield at, fields, document, "; ".join(x for x in (problem, cut) if x) or None
        at, problem = end + 1 + n, None
    if problem is not None:
        yield at, {}, b"", problem


def warc_date(date: str) -> str:
    """An archive date of 8 to 14 digits in the newer form; what is missing is zero, what is no date
    is the first of 1970."""
    try:
        return datetime.strptime(date.ljust(14, "0"), "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ")
    except ValueError:
        return "1970-01-01T00:00:00Z"


def split_document(document: bytes) -> tuple[bytes, bytes]:
    """(head, payload) of a document; without an HTTP head all is payload."""
    if not document.startswith(b"HTTP/"):
        return b"", document
    m = re.search(rb"\r?\n\r?\n", document)
    return (document[: m.end()], document[m.end() :]) if m else (document, b"")


def converted(archive: str, at: int, fields: dict[str, str], document: bytes, problem: str | None) -> dict:
    """What a WARC record says of an ARC record: its name is made of the archive's and the place in it,
    its type of the URL's scheme and of whether there is an HTTP head, its digests of the bytes."""
    head, payload = split_document(document)
    uri, mime = fields.get("URL", ""), fields.get("Content-type", "application/octet-stream")
    if uri.startswith("filedesc://"):
        kind, mime = "warcinfo", "application/warc-fields"
    elif head:
        kind, mime = "response", "application/http; msgtype=response"
    elif uri.startswith("dns:"):
        kind, mime = "response", "text/dns"
    else:
        kind = "resource" if fields else "problem"
    return {
        "archive": archive, "at": at, "record_id": f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(f'{archive} {at}'.encode()).digest()[:16], version=4)}>", "kind": kind, "uri": uri,
        "date": warc_date(fields.get("Archive-date", "")), "ip": fields.get("IP-address"), "content_type": mime, "head": head, "payload": payload,
        "payload_sha1": sha1_of(payload), "block_sha1": sha1_of(head, payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "problem": problem,
    }


_TYPES = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary(), "map<string,string>": pa.map_(pa.string(), pa.string())}


def _batched(rows: Iterator[dict], schema: str, weight: str) -> Iterator[pa.RecordBatch]:
    """Rows in batches of some megabytes."""
    fields, held, size = [f.split() for f in schema.split(", ")], [], 0

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in held], _TYPES[t]) for n, t in fields], [n for n, _ in fields])

    for r in rows:
        held.append(r)
        size += len(r[weight]) + 500
        if size > 4 << 20:
            yield out()
            held, size = [], 0
    if held:
        yield out()


def _arc_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[dict]:
        for b in batches:
            for k in range(b.num_rows):
                name = b.column(0)[k].as_py().rsplit("/", 1)[-1]
                for x in arc_records(unpacked(b.column(1)[k].as_py() or b"")):
                    yield converted(name, *x)

    return _batched(rows(), _RECORD, "payload")


def read_arc(archives: DataFrame) -> DataFrame:
    """The records of archives(path, content) in the legacy format, plain or gzip, as WARC records are to
    tell them: archive, at, record_id, kind, uri, date, ip, content_type, head, payload, digests, problem.

    An archive is one row, as Spark's binaryFile gives it, so it has to fit a task; a null one has no
    records. Names of records depend on the archive's name and the place, so reading again gives the same."""
    return narrow(archives, "path", "content").mapInArrow(_arc_rows, _RECORD)


# ---- WARC


def with_originals(records: DataFrame, key: str = "key", least: int = 0) -> DataFrame:
    """records with original, the record_id, uri and date of the one that they repeat: of responses with
    equal payloads of at least `least` bytes that with the largest key; null for that one and for others.

    Payloads are equal if their SHA-256 is. Of equal keys the largest record_id. Groups are found by one
    combined aggregation; those of more than one record are sent to the records if they are few,
    else both are shuffled by a join that Spark may split at a hot payload."""
    long_enough = (F.col("kind") == "response") & (F.octet_length("payload") >= least)
    best = F.max(F.struct(key, "record_id", "uri", "date")).alias("best")
    groups = records.where(long_enough).groupBy(F.col("payload_sha256").alias("of")).agg(F.count("*").alias("n"), best).where("n > 1")
    groups = written(groups.select("of", F.struct("best.record_id", "best.uri", "best.date").alias("original")))
    few = groups.count() <= SENT
    met = records.join(F.broadcast(groups) if few else groups.hint("merge"), (F.col("payload_sha256") == F.col("of")) & long_enough, "left").drop("of")
    return met.withColumn("original", F.when(F.col("original.record_id") != F.col("record_id"), F.col("original")))


def warc_record(r: dict) -> bytes:
    """A record, without the two line ends behind it; one with an original has no payload."""
    first, kind = r.get("original"), r["kind"]
    block = r["head"] if first else r["head"] + r["payload"]
    said = [
        ("WARC-Type", "revisit" if first else kind), ("WARC-Record-ID", r["record_id"]), ("WARC-Date", r["date"]), ("WARC-Target-URI", None if kind == "warcinfo" else clean_uri(r["uri"], r["at"])),
        ("WARC-Filename", r["archive"] if kind == "warcinfo" else None), ("WARC-IP-Address", r["ip"] if kind != "warcinfo" else None), ("WARC-Payload-Digest", f"sha1:{r['payload_sha1']}" if kind != "warcinfo" else None),
        ("WARC-Block-Digest", f"sha1:{sha1_of(block) if first else r['block_sha1']}"), ("WARC-Truncated", "unspecified" if r["problem"] and "bytes" in r["problem"] else None),
        *([("WARC-Profile", REVISIT), ("WARC-Refers-To", first["record_id"]), ("WARC-Refers-To-Target-URI", clean_uri(first["uri"], "")), ("WARC-Refers-To-Date", first["date"])] if first else []),
        ("Content-Type", r["content_type"]), ("Content-Length", len(block)),
    ]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in said if v is not None) + "\r\n").encode() + block


def _as_warc(size: int):  # noqa: ANN202
    """Records to archives of some size bytes."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, have = [], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([b"\r\n\r\n".join(held)], pa.binary())], ["value"])

        for b in batches:
            names = b.schema.names
            for k in range(b.num_rows):
                record = warc_record({n: b.column(i)[k].as_py() for i, n in enumerate(names)})
                if held and have + len(record) > size:
                    yield out()
                    held, have = [], 0
                held.append(record)
                have += len(record)
        if held:
            yield out()

    return made


def write_warc(records: DataFrame, path: str, size: int = ARCHIVE) -> None:
    """Records of read_arc, with originals or without, as gzip WARC files of some size bytes. What
    could not be read of an archive is left out."""
    names = [f.split()[0] for f in _RECORD.split(", ")] + (["original"] if "original" in records.columns else [])
    _stored_as(narrow(records, *names).where("kind <> 'problem'").mapInArrow(_as_warc(size), "value binary"), path, "\r\n\r\n")


def warc_records(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes, str | None]]:
    """(place, fields by lower-case name, block, problem) of the records of an archive, by their declared lengths."""
    at = 0
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        end = data.find(b"\r\n\r\n", at)
        lines = data[at : len(data) if end < 0 else end].decode("utf-8", "replace").split("\r\n")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        if end < 0 or not lines[0].startswith("WARC/") or not fields.get("content-length", "").isdigit():
            after = data.find(b"\r\nWARC/", at)  # what stands before the next record is lost, and told
            yield at, {}, b"", f"no record at {at}"
            at = len(data) if after < 0 else after + 2
            continue
        n = int(fields["content-length"])
        block = data[end + 4 : end + 4 + n]
        yield at, fields, block, None if len(block) == n else f"{len(block)} of {n} bytes"
        at = end + 4 + n


def _warc_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[dict]:
        for b in batches:
            for k in range(b.num_rows):
                name = b.column(0)[k].as_py().rsplit("/", 1)[-1]
                for at, fields, block, problem in warc_records(unpacked(b.column(1)[k].as_py() or b"")):
                    yield {"archive": name, "at": at, "fields": list(fields.items()), "block": block, "problem": problem}

    return _batched(rows(), _READ, "block")


def read_warc(archives: DataFrame) -> DataFrame:
    """archive, at, fields, block, problem of the records of archives(path, content), plain or gzip."""
    return narrow(archives, "path", "content").mapInArrow(_warc_rows, _READ)


def archives(spark: SparkSession, path: str) -> DataFrame:
    """path, content of the archives in a folder."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def convert(spark: SparkSession, source: str, target: str, least: int = 0, size: int = ARCHIVE) -> None:
    """Legacy archives of a folder to WARC archives in another. Each record keeps its document, byte by
    byte, but repeated payloads, which become revisits of one response; rows are told apart by the
    header X-Row if there is one, else by the record's name."""
    records = read_arc(archives(spark, source))
    row = F.nullif(F.regexp_extract(F.col("head").cast("string"), r"\r\nX-Row: (-?\d*)\r\n", 1), F.lit("")).cast("bigint")
    write_warc(with_originals(records.withColumn("key", row), "key", least), target, size)


_SHOWN = "page_id long, payload_bytes long, payload_digest string, record_id string, kind string, refers string"


def _seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(fields, block) to what the page's record says; the digest is of the bytes that were read."""
    for b in batches:
        rows = []
        for fields, block in zip(*(c.to_pylist() for c in b.columns), strict=True):
            fields = dict(fields)
            head, payload = split_document(block)
            row = re.search(rb"\r\nX-Row: (-?\d+)\r\n", head)
            full = fields["warc-type"] == "response"
            rows.append((row and int(row[1]), len(payload) if full else None, sha1_of(payload) if full else None, fields["warc-record-id"], fields["warc-type"], fields.get("warc-refers-to")))
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], [f.split()[0] for f in _SHOWN.split(", ")])


def pages_of(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of read records of pages: a revisit
    has no payload of its own and is told by the response that it refers to, found by a join."""
    wanted = records.where("fields['warc-type'] in ('response', 'revisit')").select("fields", "block")
    seen = written(wanted.mapInArrow(_seen, _SHOWN))
    full, again = seen.where("kind = 'response'"), seen.where("kind = 'revisit'")
    first = full.select(F.col("record_id").alias("refers"), "payload_bytes", "payload_digest", F.col("page_id").alias("refers_to"))
    told = again.select("page_id", "refers").join(first, "refers").select("page_id", "payload_bytes", "payload_digest", F.lit("revisit").alias("record_type"), "refers_to")
    return full.select("page_id", "payload_bytes", "payload_digest", F.lit("response").alias("record_type"), F.lit(None).cast("bigint").alias("refers_to")).unionByName(told)


def warc_pages(pages: DataFrame, least: int = 0, size: int = ARCHIVE) -> DataFrame:
    """One row per row of pages(page_id, url, html): page_id, payload_bytes, payload_digest, record_type,
    refers_to, as read back from WARC archives that were converted from ARC archives of the pages.

    Pages are written as legacy archives of both versions, these are parsed by their header lines and
    declared lengths, converted and written as WARC, and that is read back. A null html is an empty
    payload, a null or blank url is named by the row, spaces in one are escaped. Of equal payloads of at
    least `least` bytes the row with the largest page_id, null the smallest, is the response; rows that
    repeat a page_id are told apart by their place. An archive holds some size bytes or one longer
    record. Empty tables give no rows; other columns are not read, whatever their names."""
    spark = pages.sparkSession
    root = f"{shared_dir(spark)}/lodestone-warc-{uuid.uuid4().hex}"
    forget_at_exit(spark, root)
    write_arc(pages, f"{root}/arc", size)
    convert(spark, f"{root}/arc", f"{root}/warc", least, size)
    return pages_of(read_warc(archives(spark, f"{root}/warc")))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """warc_pages over all pages."""
    return warc_pages(table(spark, sf_dir, "pages"))


OP12_SQL = """
with p as (select page_id, coalesce(html, '') as t from pages),
d as (
  select *, sha1(t) as h, row_number() over w = 1 as first, max(page_id) over (partition by t) as most
  from p window w as (partition by t order by page_id desc nulls last)
)
select page_id, strlen(t) as payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (1 + (('0x' || substr(h, ((i // 4) * 5 + 1)::int, 5))::bigint >> (15 - 5 * (i % 4))::int) % 32)::int, 1)), '') as payload_digest,
       case when first then 'response' else 'revisit' end as record_type, case when not first then most end as refers_to
from d
"""
