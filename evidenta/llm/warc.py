"""Legacy archives: ARC reading, conversion to WARC, and WARC reading.

``arc_volumes`` writes documents as ARC volumes: a ``filedesc:`` version block that names version 1 or 2
and its field list, then one record a page: URL record line, declared length, network document.
``convert`` parses such volumes. The header line of a record has the fields of the version
its volume declares (v1: URL, IP, date, type, length; v2 adds result code, checksum, location, offset and
file name), and the body is cut by the declared length alone, never by looking for a separator. The
WARC equivalents are synthesised: a name-based ``urn:uuid`` from URL, date, payload digest and record position,
the 14-digit date as ISO 8601, the record type from the content (``warcinfo`` for a version block), and
SHA-256 block and payload digests. Of equal payloads of at least ``floor`` bytes, the one with the
smallest id stays a ``response``; the others become ``revisit`` records that keep the HTTP header
and refer to it by ``WARC-Refers-To``, its target URI and its date. An unreadable date becomes that of the volume.

Archives are real files in the shared folder. Executors hand finished volumes to Spark's text
writer (a value is written byte for byte, and the file gzipped), with ``CR LF CR LF`` between WARC records and ``LF`` between ARC
ones, and read them as binary files, so any file system that Spark reaches will do. A file
holds volumes of bounded size.

Defined cases: a null page is an empty payload; a null URL is ``unknown:``; white space in a URL is
percent-encoded; repeated rows are separate records (of equal payloads and equal ids all are
``response``); a null id comes back null and ranks after all others; other columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidenta.llm.common import Scratch

VOLUME = 8 << 20  # bytes of records after which a volume is closed
VOLUMES_A_FILE = 4
FLOOR = 100
CAPTURED = "20240102030405"
# Fixed values of the ARC format.
FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL name space of RFC 9562


def arc_version_block(version: int, name: str, date: str = CAPTURED) -> bytes:
    """The first record of an ARC volume."""
    body = f"{version} 0 evidenta\n{' '.join(FIELDS[version])}\n\n".encode()
    extra = "" if version == 1 else " 200 - - 0 " + name
    return f"filedesc://{name} 0.0.0.0 {date} text/plain{extra} {len(body)}\n".encode() + body


def arc_record(version: int, url: str, body: bytes, name: str, offset: int, date: str = CAPTURED, mime: str = "text/html", status: int = 200) -> bytes:
    extra = "" if version == 1 else f" {status} {hashlib.md5(body).hexdigest()} - {offset} {name}"
    return f"{url} 0.0.0.0 {date} {mime}{extra} {len(body)}\n".encode() + body


def clean_url(url: str | None) -> str:
    return re.sub(r"\s", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url) if url else "unknown:"


def http_document(payload: bytes, page_id: str | None) -> bytes:
    """A network document: status line, headers, payload. The id travels in a header of its own."""
    own = f"X-Page-Id: {page_id}\r\n" if page_id is not None else ""
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n{own}\r\n".encode() + payload


def _volumes(batches: Iterator[pd.DataFrame], volume: int) -> Iterator[pd.DataFrame]:
    """ARC volumes of a partition; versions alternate."""
    made, parts, held = 0, [], 0

    def opened() -> tuple[int, str]:
        version = 1 + made % 2
        return version, f"volume-{made}.arc"

    for batch in batches:
        out = []
        for page_id, url, html in zip(batch["page_id"], batch["url"], batch["html"], strict=True):
            version, name = opened()
            if not parts:
                parts = [arc_version_block(version, name)]
                held = len(parts[0])
            body = http_document((html or "").encode("utf-8", "surrogatepass"), page_id)
            parts.append(arc_record(version, clean_url(url), body, name, held))
            held += len(parts[-1]) + 1
            if held >= volume:
                out.append(b"\n".join(parts))
                made, parts = made + 1, []
        if out:
            yield pd.DataFrame({"bytes": out})
    if parts:
        yield pd.DataFrame({"bytes": [b"\n".join(parts)]})


def plain(data: bytes) -> bytes:
    """The bytes of a file that may be gzipped, in one member or several."""
    return gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data


def parse_arc(data: bytes) -> Iterator[dict]:
    """Records of concatenated ARC volumes, the version block of each first.

    Raises ValueError for a header line that has not the fields of its version, a record
    that ends before its declared length, or one without a readable date in a volume without one.
    """
    at, version, n, opened_at = 0, 1, 0, ""
    while at < len(data):
        if data[at : at + 1] in b"\r\n":  # between records
            at += 1
            continue
        end = data.find(b"\n", at)
        line = data[at : end if end >= 0 else len(data)].decode("utf-8", "surrogateescape").rstrip("\r")
        fields = line.split(" ")
        if fields[0].startswith("filedesc:"):
            head = data[end + 1 : data.find(b"\n", end + 1)].split(b" ")
            version = int(head[0])
            if version not in FIELDS:
                raise ValueError(f"ARC version {version} is not known")
        if end < 0 or len(fields) != len(FIELDS[version]) or not fields[-1].isdigit():
            raise ValueError(f"not an ARC version {version} record line at byte {at}: {line[:200]!r}")
        length = int(fields[-1])
        body = data[end + 1 : end + 1 + length]
        if len(body) != length:
            raise ValueError(f"an ARC record at byte {at} declares {length} bytes and has {len(body)}")
        record = {**dict(zip(FIELDS[version], fields, strict=True)), "version": version, "position": n, "body": body}
        if fields[0].startswith("filedesc:"):
            opened_at = record["Archive-date"]
        # an unreadable date is that of the volume, which has to be readable
        record["when"] = iso_date(record["Archive-date"]) or iso_date(opened_at)
        if record["when"] is None:
            raise ValueError(f"no readable date for the ARC record at byte {at}: {record['Archive-date']!r}, in a volume of {opened_at!r}")
        yield record
        n += 1
        at = end + 1 + length


def split_http(body: bytes) -> tuple[bytes, dict[str, str], bytes]:
    """Header block, its fields in lower case, and payload of a network document."""
    if not body.startswith(b"HTTP/"):
        return b"", {}, body
    end = body.find(b"\r\n\r\n")
    end = len(body) if end < 0 else end + 4
    named = (line.partition(b":") for line in body[:end].split(b"\r\n")[1:] if b":" in line)
    return body[:end], {k.strip().lower().decode("latin-1"): v.strip().decode("latin-1") for k, _, v in named}, body[end:]


def iso_date(date: str) -> str | None:
    """A 14-digit (or shorter) ARC date as ISO 8601; what is missing is the earliest. None if it is unreadable."""
    digits = (date + "00000101000000"[len(date) :])[:14] if len(date) < 14 else date[:14]
    try:
        return datetime.strptime(digits, "%Y%m%d%H%M%S").replace(tzinfo=timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    except ValueError:
        return None


def record_id(url: str, date: str, digest: str, place: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{url} {date} {digest} {place}')}>"


def warc_record(kind: str, url: str, date: str, rid: str, block: bytes, mime: str, **more: str) -> bytes:
    """A WARC 1.1 record without the separator that follows it."""
    head = {"WARC-Type": kind, "WARC-Record-ID": rid, "WARC-Date": date, "WARC-Target-URI": url, "Content-Type": mime, "WARC-Block-Digest": f"sha256:{hashlib.sha256(block).hexdigest()}"}
    head |= {k.replace("_", "-"): v for k, v in more.items() if v is not None}
    if kind == "warcinfo":
        head.pop("WARC-Target-URI")
    head["Content-Length"] = str(len(block))
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode("utf-8", "surrogateescape") + b"\r\n" + block


def _pages(path: str, data: bytes) -> Iterator[tuple[dict, str | None, bytes, str, str]]:
    """Records of an ARC file: fields, page id, payload, payload digest and WARC record id."""
    for r in parse_arc(plain(data)):
        _, named, payload = split_http(r["body"])
        digest = hashlib.sha256(payload).hexdigest()
        place = f"{path.rsplit('/', 1)[-1]}#{r['position']}"
        yield r, named.get("x-page-id"), payload, digest, record_id(r["URL"], r["when"], digest, place)


def _facts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Id, size, digest and WARC identity of each page record of ARC files."""
    for batch in batches:
        for path, data in zip(batch["path"], batch["content"], strict=True):
            rows = [(page_id, len(payload), digest, rid, r["URL"], r["when"]) for r, page_id, payload, digest, rid in _pages(path, data) if not r["URL"].startswith("filedesc:")]
            yield pd.DataFrame(rows, columns=["page_id", "payload_bytes", "payload_digest", "record_id", "url", "date"])


def _parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["page_id", "url", "date", "mime", "rid", "digest", "body"]
    for batch in batches:
        for path, data in zip(batch["path"], batch["content"], strict=True):
            rows, held = [], 0
            for r, page_id, _, digest, rid in _pages(path, data):
                rows.append((page_id, r["URL"], r["when"], r["Content-type"], rid, digest, r["body"]))
                held += len(r["body"])
                if held >= VOLUME or len(rows) >= 256:
                    yield pd.DataFrame(rows, columns=columns)
                    rows, held = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=columns)


def _warc(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """WARC volumes of converted records; ``refers_to`` is set for revisits."""
    parts, held = [], 0
    for batch in batches:
        out = []
        for url, when, mime, rid, digest, body, refers_to, first_rid, first_url, first_date in batch.itertuples(index=False):
            digest_ = f"sha256:{digest}"
            if url.startswith("filedesc:"):
                parts.append(warc_record("warcinfo", url, when, rid, body, "text/plain"))
            else:
                head = split_http(body)[0]
                form = "application/http; msgtype=response" if head else mime
                if first_rid is None or first_rid != first_rid:
                    parts.append(warc_record("response" if head else "resource", url, when, rid, body, form, WARC_Payload_Digest=digest_))
                else:
                    parts.append(warc_record(
                        "revisit", url, when, rid, head, form, WARC_Payload_Digest=digest_, WARC_Refers_To=first_rid, WARC_Refers_To_Target_URI=first_url, WARC_Refers_To_Date=first_date,
                        X_Refers_To_Page=refers_to, WARC_Profile="http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                    ))
            held += len(parts[-1]) + 4
            if held >= VOLUME:
                out.append(b"\r\n\r\n".join(parts))
                parts, held = [], 0
        if out:
            yield pd.DataFrame({"bytes": out})
    if parts:
        yield pd.DataFrame({"bytes": [b"\r\n\r\n".join(parts)]})


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Named fields (lower case) and block of each record, by declared lengths."""
    at = 0
    while at < len(data):
        if data[at : at + 1] in b"\r\n":
            at += 1
            continue
        end = data.find(b"\r\n\r\n", at)
        if not data.startswith(b"WARC/1.", at) or end < 0:
            raise ValueError(f"not a WARC record at byte {at}")
        named = (x.partition(b":") for x in data[at:end].split(b"\r\n")[1:])
        head = {k.strip().lower().decode(): v.strip().decode("utf-8", "surrogateescape") for k, _, v in named}
        length = int(head["content-length"])
        block = data[end + 4 : end + 4 + length]
        if len(block) != length:
            raise ValueError(f"a WARC record at byte {at} declares {length} bytes and has {len(block)}")
        yield head, block
        at = end + 4 + length


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "refers_to_record", "record_id", "url", "date"]
    for batch in batches:
        for data in batch["content"]:
            rows = []
            for head, block in parse_warc(plain(data)):
                kind = head["warc-type"]
                if kind == "warcinfo":
                    continue
                _, named, payload = split_http(block)
                digest = head["warc-payload-digest"].partition(":")[2]
                size = int(named["content-length"]) if kind == "revisit" else len(payload)
                if kind != "revisit" and hashlib.sha256(payload).hexdigest() != digest:
                    raise ValueError(f"the payload of {head['warc-record-id']} does not match its digest")
                rows.append((named.get("x-page-id"), size, digest, kind, head.get("x-refers-to-page"), head.get("warc-refers-to"), head["warc-record-id"], head.get("warc-target-uri"), head["warc-date"]))
            yield pd.DataFrame(rows, columns=columns)


def files(frame: DataFrame, folder: str, between: str) -> None:
    """Write volumes (column ``bytes``) as files of a few volumes each."""
    frame.select(F.col("bytes").cast("string").alias("value")).write.option("lineSep", between).option("maxRecordsPerFile", VOLUMES_A_FILE).option("compression", "gzip").text(folder)


def opened(spark, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.txt.gz").load(folder).select("path", "content")


def write_arc(pages: DataFrame, folder: str, volume: int = VOLUME) -> None:
    rows = pages.select(F.col("page_id").cast("string").alias("page_id"), "url", "html")
    files(rows.mapInPandas(lambda it: _volumes(it, volume), "bytes binary"), folder, "\n")


def convert(spark, arc_folder: str, warc_folder: str, scratch: Scratch, floor: int = FLOOR) -> None:
    """Convert the ARC files of one folder into WARC files of another.

    Which record is the response of its payload is found on digests first (small rows). Payloads
    then go through unshuffled unless the table of revisits is too large to broadcast.
    """
    facts = opened(spark, arc_folder).mapInPandas(_facts, "page_id string, payload_bytes long, payload_digest string, record_id string, url string, date string")
    facts = scratch.save(facts.withColumn("id", F.col("page_id").cast("long")), "facts")
    named = F.struct("id", "record_id", "url", "date")
    large = facts.where(F.col("payload_bytes") >= floor)
    first = large.where("id is not null").groupBy("payload_digest").agg(F.min(named).alias("first"))
    again = large.join(first, "payload_digest").where("id is null or id != first.id")
    again = scratch.save(again.select(F.col("record_id").alias("of"), F.col("first.id").cast("string").alias("refers_to"), F.col("first.record_id").alias("first_rid"), F.col("first.url").alias("first_url"), F.col("first.date").alias("first_date")), "revisits")
    schema = "page_id string, url string, date string, mime string, rid string, digest string, body binary"
    records = opened(spark, arc_folder).mapInPandas(_parsed, schema)
    # record ids are unique; Spark broadcasts the revisits only if they are small
    marked = records.join(again, F.col("rid") == F.col("of"), "left")
    marked = marked.select("url", "date", "mime", "rid", "digest", "body", "refers_to", "first_rid", "first_url", "first_date")
    files(marked.mapInPandas(_warc, "bytes binary"), warc_folder, "\r\n\r\n")


def read_warc(spark, folder: str) -> DataFrame:
    """Page records of WARC files; payloads are checked against their digests."""
    schema = "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string, refers_to_record string, record_id string, url string, date string"
    found = opened(spark, folder).mapInPandas(_read, schema)
    return found.withColumn("page_id", F.col("page_id").cast("long")).withColumn("refers_to", F.col("refers_to").cast("long"))


def archived(pages: DataFrame, floor: int = FLOOR) -> DataFrame:
    """Pages to ARC files, those to WARC files, and what these say when read back."""
    spark = pages.sparkSession
    scratch = Scratch(spark, "archives")
    arc, warc = scratch.path("arc"), scratch.path("warc")
    write_arc(pages, arc)
    convert(spark, arc, warc, scratch, floor)
    scratch.drop(arc)
    return read_warc(spark, warc)
