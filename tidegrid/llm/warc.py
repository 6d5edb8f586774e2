"""Legacy web archives (ARC, versions 1 and 2) and their conversion to WARC.

The converter reads version-specific ARC header lines and declared lengths, and makes the equivalent WARC
records: identifiers, timestamps, types and digests. Archives are gzip members, one a record, in bounded
files; every task names its files by itself, and only files named in the finished task's rows are read, so a
task that is run again leaves no record twice.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.llm.common import join_hot, shared_path, staged

#: Payloads under this size are never made revisits.
LEAST_REVISIT = 100
#: Compressed bytes after which a task starts another archive.
ARCHIVE_BYTES = 32 << 20
#: The field lists that the version block of each ARC version declares.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:tidegrid:warc")
_ID = re.compile(rb"\r\nX-Page-Id: (\S*)\r\n")


def uri(path: str) -> str:
    return path if "://" in path else f"file://{path}" if path.startswith("/") else re.sub("^file:/+", "file:///", path)


def page_of(block: bytes) -> str | None:
    """The page id in a block's HTTP headers, if there is one."""
    found = _ID.search(block, 0, block.find(b"\r\n\r\n") + 4)
    return urllib.parse.unquote(found[1].decode()) if found else None


def create_folder(path: str) -> None:
    files, at = fs.FileSystem.from_uri(uri(path))
    files.create_dir(at, recursive=True)


class Archive:
    """Writes gzip members to files of bounded size in any store that pyarrow can open."""

    def __init__(self, folder: str, kind: str, opening):
        self.files, self.at = fs.FileSystem.from_uri(uri(folder))
        self.folder, self.kind, self.opening, self.out, self.name, self.used = folder, kind, opening, None, "", 0

    def add(self, record: bytes) -> tuple[str, int]:
        """The file's name and the record's place in it."""
        if self.out is None or self.used >= ARCHIVE_BYTES:
            self.close()
            self.name, self.used = f"{uuid.uuid4().hex}.{self.kind}.gz", 0
            self.out = self.files.open_output_stream(f"{self.at}/{self.name}", compression=None)
            self._put(self.opening(self.name))
        place = self.used
        self._put(record)
        return self.name, place

    def _put(self, record: bytes) -> None:
        packed = gzip.compress(record, 4, mtime=0)
        self.out.write(packed)
        self.used += len(packed)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None


def members(folder: str, name: str) -> Iterator[tuple[int, bytes]]:
    """Place and bytes of every gzip member of an archive, read as a stream."""
    files, at = fs.FileSystem.from_uri(uri(folder))
    with files.open_input_stream(f"{at}/{name}", compression=None) as f:
        place, rest = 0, b""
        while rest or (rest := f.read(1 << 18)):
            unpack, parts, used = zlib.decompressobj(31), [], 0
            while not unpack.eof:
                if not rest and not (rest := f.read(1 << 18)):
                    raise ValueError(f"{name}: it ends within the record at {place}")
                parts.append(unpack.decompress(rest))
                used += len(rest) - len(unpack.unused_data)
                rest = unpack.unused_data
            yield place, b"".join(parts)
            place += used


def arc_opening(version: int, name: str, date: str) -> bytes:
    """The version block: a file description, the version line and the list of fields."""
    block = f"{version} 0 tidegrid\n{ARC_FIELDS[version]}\n\n".encode()
    extra = f"200 - - 0 {name} " if version == 2 else ""
    return f"filedesc://{name} 0.0.0.0 {date} text/plain {extra}{len(block)}\n".encode() + block


def arc_record(version: int, name: str, page_id: int | str | None, url: str | None, payload: bytes, date: str) -> bytes:
    """One ARC record: header line, HTTP response, newline. White space in a URL is escaped, a null one named by a dash."""
    own = f"X-Page-Id: {urllib.parse.quote(str(page_id), safe='')}\r\n" if page_id is not None else ""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n{own}Content-Length: {len(payload)}\r\n\r\n".encode() + payload
    place = re.sub(r"\s", lambda m: f"%{ord(m[0]):02X}", url or "") or "-"
    extra = f"200 {hashlib.md5(payload).hexdigest()} - 0 {name} " if version == 2 else ""
    return f"{place} 0.0.0.0 {date} text/html {extra}{len(http)}\n".encode() + http + b"\n"


@dataclass
class ArcRecord:
    url: str
    ip: str
    date: str
    mime: str
    block: bytes

    @property
    def page_id(self) -> str | None:
        return page_of(self.block)

    @property
    def payload(self) -> bytes:
        return self.block.partition(b"\r\n\r\n")[2] if self.block.startswith(b"HTTP/") else self.block


def parse_arc(raw: bytes, version: int) -> ArcRecord:
    """A record by its header line: five fields in version 1, ten in version 2, the declared length last.

    A URL may hold blanks (some writers leave them): the fields are counted from the right.
    """
    line, _, rest = raw.partition(b"\n")
    fields = line.decode("utf-8", "replace").rsplit(" ", len(ARC_FIELDS[version].split()) - 1)
    if len(fields) != len(ARC_FIELDS[version].split()) or not fields[-1].isdigit():
        raise ValueError(f"not an ARC header of version {version}: {line[:80]!r}")
    length = int(fields[-1])
    if len(rest) < length:
        raise ValueError(f"{length} bytes are declared, {len(rest)} are there: {line[:80]!r}")
    return ArcRecord(fields[0], fields[1], fields[2], fields[3], rest[:length])


def arc_version(raw: bytes) -> int:
    """The version that the opening block of an archive declares."""
    line, _, rest = raw.partition(b"\n")
    if not line.startswith(b"filedesc://"):
        raise ValueError(f"no version block: {line[:80]!r}")
    return int(rest.split(b" ", 1)[0])


def arc_records(folder: str, name: str) -> Iterator[tuple[int, ArcRecord]]:
    version = 0
    for place, raw in members(folder, name):
        if place == 0:
            version = arc_version(raw)
        else:
            yield place, parse_arc(raw, version)


def warc_date(date: str) -> str:
    """YYYYMMDDhhmmss, or its first 4, 6, 8, 10 or 12 digits, as an ISO time in UTC."""
    full = date + "00000101000000"[len(date) :]
    return f"{full[:4]}-{full[4:6]}-{full[6:8]}T{full[8:10]}:{full[10:12]}:{full[12:14]}Z"


def record_id(url: str, date: str, digest: str, page_id: str | None) -> str:
    """A name-based UUID: the same record gets the same identifier in every run."""
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{url} {date} {digest} {page_id}')}>"


def warc_record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [("WARC-Type", kind), *headers, ("Content-Length", str(len(block)))])
    return f"WARC/1.1\r\n{head}\r\n".encode() + block + b"\r\n\r\n"


@dataclass
class Response:
    """The response that a revisit stands for."""

    page_id: str
    url: str
    date: str


def convert_record(arc: ArcRecord, refers_to: Response | None, digest: str) -> bytes:
    """The equivalent WARC record; a revisit keeps the HTTP headers and names the response it stands for by its record's id,
    URI and date, and by its page in a header of its own."""
    payload = arc.payload
    date = warc_date(arc.date)
    headers = [
        ("WARC-Record-ID", record_id(arc.url, date, digest, arc.page_id)),
        ("WARC-Date", date),
        ("WARC-Target-URI", arc.url),
        ("WARC-IP-Address", arc.ip),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("X-Payload-Length", str(len(payload))),
    ]
    if refers_to is None:
        return warc_record("response", [*headers, ("Content-Type", "application/http; msgtype=response")], arc.block)
    headers += [
        ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
        ("WARC-Refers-To", record_id(refers_to.url, warc_date(refers_to.date), digest, refers_to.page_id)),
        ("WARC-Refers-To-Target-URI", refers_to.url),
        ("WARC-Refers-To-Date", warc_date(refers_to.date)),
        ("X-Refers-To-Page", urllib.parse.quote(refers_to.page_id, safe="")),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    return warc_record("revisit", headers, arc.block[: len(arc.block) - len(payload)])


def parse_warc(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (with WARC-Type) and block of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8", "replace").split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError(f"not a WARC record: {first[:80]!r}")
    headers = dict(x.split(": ", 1) for x in lines)
    return headers, rest[: int(headers["Content-Length"])]


def write_arc(pages: DataFrame, folder: str, date: str = "20240101000000") -> DataFrame:
    """Write pages (page_id, url, html) to ARC archives; return, staged, archive, place, page_id, bytes and digest.

    Every second task writes version 1, the others version 2. Null html is an empty payload, a null url a
    dash, a null page_id leaves its header out. Repeated rows are records of their own.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        version = 1 + TaskContext.get().partitionId() % 2
        out = Archive(folder, "arc", lambda name: arc_opening(version, name, date))
        for b in batches:
            rows = []
            for page, url, payload in zip(b["page_id"], b["url"], b["_raw"]):
                name, place = out.add(arc_record(version, out.name or "-", page, url, payload, date))
                rows.append((name, place))
            yield pd.DataFrame(rows, columns=["archive", "place"])
        out.close()

    create_folder(folder)
    rows = pages.select(F.col("page_id").cast("string"), "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("_raw"))
    return staged(rows.mapInPandas(write, "archive string, place long"), "arc-index")


def read_arc(index: DataFrame, folder: str, kind: str = "bigint") -> DataFrame:
    """archive, place, page_id (of type ``kind``), url, date, payload_bytes and digest of every record in the archives that
    index names, staged. Each archive is a task's work of its own."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name in b["archive"]:
                rows = []
                for place, arc in arc_records(folder, name):
                    payload = arc.payload
                    rows.append((name, place, arc.page_id, arc.url, arc.date, len(payload), hashlib.sha256(payload).hexdigest()))
                yield pd.DataFrame(rows, columns=["archive", "place", "page_id", "url", "date", "payload_bytes", "digest"])

    names = index.select("archive").distinct()
    found = names.repartition(max(1, names.count())).mapInPandas(
        read, "archive string, place long, page_id string, url string, date string, payload_bytes long, digest string"
    )
    return staged(found.withColumn("page_id", F.col("page_id").cast(kind)), "arc-records")


def with_revisits(records: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """Records with ``first``: page_id, url and date of the record with the smallest page_id of those with an equal payload of
    at least ``least`` bytes.

    Null for that one itself (and for all that share its page_id), for small payloads, and where no page_id is
    known. Only digests that occur twice or more are looked up; of a digest that very many records share, the
    minimum is taken before the shuffle, and what is known of it is broadcast, so that its records don't meet.
    """
    same = (
        records.filter(F.col("payload_bytes") >= least)
        .groupBy("digest", "payload_bytes")
        .agg(F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url", "date"))).alias("first"), F.count("*").alias("n"))
        .filter("n > 1 and first is not null")
        .select("digest", "payload_bytes", "first", "n")
    )
    found = join_hot(records, staged(same, "same-payloads"), ["digest", "payload_bytes"], "n", records.count(), how="left")
    return found.withColumn("first", F.when(~F.col("first.page_id").eqNullSafe(F.col("page_id")), F.col("first")))


def convert(records: DataFrame, arc_folder: str, warc_folder: str) -> DataFrame:
    """Convert the archives of records (archive, place, digest, first); return, staged, the WARC files written.

    All records of one archive, whose size is bounded, are one group; there are as many tasks as archives.
    """

    def run(df: pd.DataFrame) -> pd.DataFrame:
        by_place = {
            place: (digest, None if pd.isna(page) else Response(page, url, date))
            for place, digest, page, url, date in zip(df["place"], df["digest"], df["first_page"], df["first_url"], df["first_date"])
        }
        source = df["archive"].iloc[0]
        opening = lambda name: warc_record(
            "warcinfo", [("WARC-Record-ID", record_id(source, name, "", None)), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], f"source: {source}\r\n".encode()
        )
        out, names = Archive(warc_folder, "warc", opening), set()
        for place, arc in arc_records(arc_folder, source):
            digest, refers = by_place[place]
            names.add(out.add(convert_record(arc, refers, digest))[0])
        out.close()
        return pd.DataFrame({"archive": sorted(names)})

    create_folder(warc_folder)
    rows = records.select(
        "archive", "place", "digest", F.col("first.page_id").cast("string").alias("first_page"), F.col("first.url").alias("first_url"), F.col("first.date").alias("first_date")
    )
    archives = max(1, records.select("archive").distinct().count())
    return staged(rows.repartition(archives, "archive").groupBy("archive").applyInPandas(run, "archive string"), "warc-index")


RECORD = "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string, record_id string, warc_date string, target_uri string, refers_to_id string"


def read_warc(files: DataFrame, folder: str, kind: str = "bigint") -> DataFrame:
    """``RECORD`` (pages of type ``kind``) of every response and revisit in the WARC files; a response's digest is checked
    against its payload. There are as many tasks as files."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name in b["archive"]:
                rows = []
                for _, raw in members(folder, name):
                    head, block = parse_warc(raw)
                    if head["WARC-Type"] == "warcinfo":
                        continue
                    digest, size = head["WARC-Payload-Digest"].removeprefix("sha256:"), int(head["X-Payload-Length"])
                    if head["WARC-Type"] == "response":
                        payload = block.partition(b"\r\n\r\n")[2]
                        if hashlib.sha256(payload).hexdigest() != digest or len(payload) != size:
                            raise ValueError(f"{name}: a payload is not what its digest says")
                    refers = head.get("X-Refers-To-Page")
                    rows.append(
                        (
                            page_of(block), size, digest, head["WARC-Type"], None if refers is None else urllib.parse.unquote(refers),
                            head["WARC-Record-ID"], head["WARC-Date"], head["WARC-Target-URI"], head.get("WARC-Refers-To"),
                        )
                    )
                yield pd.DataFrame(rows, columns=[x.split()[0] for x in RECORD.split(", ")])

    found = files.repartition(max(1, files.count())).mapInPandas(read, RECORD)
    return found.withColumns({c: F.col(c).cast(kind) for c in ("page_id", "refers_to")})


def archive_pages(spark: SparkSession, pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Pages to ARC archives, these to WARC archives, read back: one row of ``RECORD`` per page row.

    Empty tables give empty results; extra columns are not read. Files stay in ``folder``, by default a new one
    in the cluster's shared folder. Page ids keep their type.
    """
    folder = folder or shared_path(spark, "archives")
    kind = pages.schema["page_id"].dataType.simpleString()
    index = write_arc(pages, f"{folder}/arc")
    records = with_revisits(read_arc(index, f"{folder}/arc", kind))
    return read_warc(convert(records, f"{folder}/arc", f"{folder}/warc"), f"{folder}/warc", kind)
