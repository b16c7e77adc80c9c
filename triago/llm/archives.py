"""Legacy ARC archives to WARC.

An ARC file opens with a version block that tells its record line: version 1 has ``URL IP date type length``, version 2
``URL IP date type result checksum location offset filename length``. Each record is such a line, then as many bytes as
declared, then a line feed. The converter reads the version block, parses record lines for that version, and gives each
record a WARC identifier (a UUID made from its url, date and content, the same on every run), an ISO timestamp, a type
and digests. Of records with equal payloads one stays a ``response`` and the others become ``revisit`` records, which
keep the HTTP head and refer to the response.

All archives are gzip files of one member for each record. Three passes keep payloads out of the shuffle: (1) parse ARC,
digest payloads, list records; (2) resolve equal payloads on that list, one row for each record; (3) each task reads the
ARC records of its shards again and writes WARC. An ARC shard is about 32 MB and one shard's rows meet in one task.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triago.llm.common import shared_dir, table, tasks, written
from triago.llm.shards import ShardReader, ShardWriter, opened

#: Fixed values of the ARC format: the fields of a record line by version.
ARC_FIELDS = {
    1: ("url", "ip", "date", "type", "length"),
    2: ("url", "ip", "date", "type", "result", "checksum", "location", "offset", "filename", "length"),
}
ARC_TITLES = {1: "URL IP-address Archive-date Content-type Archive-length", 2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}
NAMESPACE = uuid.UUID("6f5c0c1e-6b1c-5d0e-9a52-2f3f6e1f7a10")
LIST = "page_id long, shard string, offset long, length long, payload_bytes long, payload_digest string, record_id string, date string"
READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, warc_date string"


def gzipped(data: bytes) -> bytes:
    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


def gunzipped(data: bytes) -> bytes:
    return zlib.decompress(data, 31)


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


# --- ARC


def arc_head(version: int, name: str, date: str = "20200101000000") -> bytes:
    """The version block of an ARC file."""
    body = f"{version} 0 triago\n{ARC_TITLES[version]}\n\n".encode()
    line = {1: f"filedesc://{name} 0.0.0.0 {date} text/plain {len(body)}\n", 2: f"filedesc://{name} 0.0.0.0 {date} text/plain 200 - - 0 {name} {len(body)}\n"}[version]
    return line.encode() + body + b"\n"


def arc_record(version: int, url: str, date: str, kind: str, content: bytes, offset: int = 0, name: str = "-") -> bytes:
    """One ARC record. White space and control signs in the url are percent-encoded, as the line is split at spaces."""
    url = "".join(f"%{b:02X}" if b <= 0x20 or b == 0x7F else chr(b) if b < 0x7F else f"%{b:02X}" for b in url.encode()) or "unknown:"
    middle = "" if version == 1 else f"200 - - {offset} {name} "
    return f"{url} 0.0.0.0 {date} {kind} {middle}{len(content)}\n".encode() + content + b"\n"


def arc_version(head: bytes) -> int:
    """The version that a version block declares."""
    first, _, rest = head.partition(b"\n")
    if not first.startswith(b"filedesc://"):
        raise ValueError("an ARC file begins with a filedesc line")
    version = int(rest.split(None, 1)[0])
    if version not in ARC_FIELDS:
        raise ValueError(f"ARC version {version} is not known")
    return version


def parse_arc(record: bytes, version: int) -> tuple[dict[str, str], bytes]:
    """The header fields of an ARC record and its content of the declared length."""
    line, _, body = record.partition(b"\n")
    names = ARC_FIELDS[version]
    values = line.decode("ascii").split(" ")
    if len(values) > len(names):  # a content type such as "text/html; charset=x" holds spaces
        kept = 3
        extra = len(values) - len(names)
        values = [*values[:kept], " ".join(values[kept : kept + extra + 1]), *values[kept + extra + 1 :]]
    if len(values) != len(names):
        raise ValueError(f"an ARC {version} record line has {len(names)} fields, not {len(values)}")
    fields = dict(zip(names, values, strict=True))
    length = int(fields["length"])
    if len(body) < length:
        raise ValueError(f"an ARC record declares {length} bytes and has {len(body)}")
    return fields, body[:length]


def split_http(content: bytes) -> tuple[bytes, bytes]:
    """An HTTP message's head, with its blank line, and its payload; content that is not HTTP is all payload."""
    if not content.startswith(b"HTTP/"):
        return b"", content
    head, mark, payload = content.partition(b"\r\n\r\n")
    return head + mark, payload


def http_field(head: bytes, name: str) -> str | None:
    found = re.search(rb"(?im)^" + name.encode() + rb":[ \t]*([^\r\n]*)", head)
    return found[1].decode("latin-1") if found else None


# --- WARC


def warc_record(fields: dict[str, str], content: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()) + f"Content-Length: {len(content)}\r\n\r\n"
    return head.encode() + content + b"\r\n\r\n"


def parse_warc(record: bytes) -> tuple[dict[str, str], bytes]:
    head, _, body = record.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("a WARC record begins with its version")
    fields = dict(line.split(": ", 1) for line in lines)
    return fields, body[: int(fields["Content-Length"])]


def iso_date(arc_date: str) -> str:
    """yyyymmddhhmmss, cut off anywhere after the year, as an ISO timestamp."""
    full = arc_date + "00000101000000"[len(arc_date) :]
    return f"{full[:4]}-{full[4:6]}-{full[6:8]}T{full[8:10]}:{full[10:12]}:{full[12:14]}Z"


def record_urn(url: str, date: str, content: bytes) -> str:
    return f"urn:uuid:{uuid.uuid5(NAMESPACE, f'{url} {date} {hashlib.sha1(content).hexdigest()}')}"


# --- passes


def write_arc(pages: DataFrame, folder: str, date: str = "20200101000000") -> DataFrame:
    """Writes (page_id, url, html) as ARC shards, versions 1 and 2 in turn, and lists (shard, offset, length, version).

    The html is UTF-8, null as empty; page_id goes into an HTTP header field, so it comes back from the archive.
    """

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        version = 2
        with ShardWriter(folder, ".arc.gz") as out:
            for batch in batches:
                rows = []
                for page, url, html in zip(batch["page_id"], batch["url"], batch["html"], strict=True):
                    if out.full():
                        version = 3 - version
                        out.head = lambda name, v=version: gzipped(arc_head(v, name, date))
                        out.start()
                    payload = b"" if html is None else html.encode()
                    name = "" if pd.isna(page) else str(int(page))
                    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Page-Id: {name}\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
                    rows.append((*out.add(gzipped(arc_record(version, url or "", date, "text/html", head + payload, out.at, out.name))), version))
                yield pd.DataFrame(rows, columns=["shard", "offset", "length", "version"])

    plain = pages.select("page_id", F.col("url"), F.col("html")).withColumn("page_id", F.col("page_id").cast("long"))
    return written(plain.withColumn("page_id", F.col("page_id").cast("string")).mapInPandas(task, "shard string, offset long, length long, version int"))


def scan_arc(records: DataFrame, folder: str) -> DataFrame:
    """The list of records with digests of their payloads, read from the ARC shards."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ShardReader(folder) as source:
            for batch in batches:
                rows = []
                for shard, offset, length, version in zip(batch["shard"], batch["offset"], batch["length"], batch["version"], strict=True):
                    fields, content = parse_arc(gunzipped(source.read(shard, offset, length)), version)
                    head, payload = split_http(content)
                    page = http_field(head, "X-Page-Id")
                    rows.append((int(page) if page else None, shard, offset, length, len(payload), sha1_base32(payload), record_urn(fields["url"], fields["date"], content), fields["date"]))
                frame = pd.DataFrame(rows, columns=[x.split()[0] for x in LIST.split(", ")])
                yield frame.astype({"page_id": "Int64"})

    return written(_by_shard(records).mapInPandas(task, LIST))


def _by_shard(rows: DataFrame) -> DataFrame:
    """A shard's rows together and in order: at most the records of one shard for each key."""
    return rows.repartition(tasks(rows), "shard").sortWithinPartitions("shard", "offset")


def resolve(records: DataFrame, least: int = 0) -> DataFrame:
    """``records`` with record_type, refers_to and refers_id: of records with equal payloads of at least ``least`` bytes
    the one with the smallest page_id (ids that are null come last, then by record) is the response."""
    key = ["payload_digest", "payload_bytes"]
    first = records.where(F.col("payload_bytes") >= least).groupBy(key).agg(F.min(F.struct(F.col("page_id").isNull().alias("none"), F.col("page_id").alias("page_id"), F.col("shard").alias("shard"), F.col("offset").alias("offset"), F.col("record_id").alias("record_id"))).alias("first"), F.count(F.lit(1)).alias("n"))
    # only payloads that occur again meet their copies
    again = first.where("n > 1").select(*key, "first")
    joined = records.join(again, key, "left")
    revisit = F.col("first").isNotNull() & ~((F.col("first.shard") == F.col("shard")) & (F.col("first.offset") == F.col("offset")))
    return joined.select(*records.columns, F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("first.page_id")).alias("refers_to"), F.when(revisit, F.col("first.record_id")).alias("refers_id"))


def write_warc(records: DataFrame, arc_folder: str, folder: str) -> DataFrame:
    """Converts the listed ARC records to WARC shards and lists (shard, offset, length) of each WARC record."""
    info = gzipped(warc_record({"WARC-Type": "warcinfo", "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(NAMESPACE, 'warcinfo')}>", "WARC-Date": "2020-01-01T00:00:00Z", "Content-Type": "application/warc-fields"}, b"software: triago\r\nformat: WARC File Format 1.1\r\n"))

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        versions: dict[str, int] = {}
        fs, root = opened(arc_folder)
        with ShardReader(arc_folder) as source, ShardWriter(folder, ".warc.gz", head=lambda name: info) as out:
            for batch in batches:
                rows = []
                for r in batch.itertuples(index=False):
                    if out.full():
                        out.start()
                    if r.shard not in versions:  # the version block is the first member
                        with fs.open_input_file(f"{root}/{r.shard}") as f:
                            versions[r.shard] = arc_version(zlib.decompressobj(31).decompress(f.read(4096)))
                    fields, content = parse_arc(gunzipped(source.read(r.shard, r.offset, r.length)), versions[r.shard])
                    head, payload = split_http(content)
                    revisit = r.record_type == "revisit"
                    block = head if revisit else content
                    warc = {"WARC-Type": r.record_type, "WARC-Record-ID": f"<{r.record_id}>", "WARC-Date": iso_date(fields["date"]), "WARC-Target-URI": fields["url"], "WARC-IP-Address": fields["ip"]}
                    warc |= {"Content-Type": "application/http; msgtype=response" if head else fields["type"], "WARC-Block-Digest": f"sha1:{sha1_base32(block)}", "WARC-Payload-Digest": f"sha1:{r.payload_digest}"}
                    if revisit:
                        warc |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": f"<{r.refers_id}>"}
                        warc |= {} if pd.isna(r.refers_to) else {"X-Refers-To-Page": str(int(r.refers_to))}
                    rows.append(out.add(gzipped(warc_record(warc, block))))
                yield pd.DataFrame(rows, columns=["shard", "offset", "length"])

    needed = records.select("shard", "offset", "length", "record_type", "record_id", "payload_digest", F.col("refers_to").cast("string").alias("refers_to"), "refers_id")
    return written(_by_shard(needed).mapInPandas(task, "shard string, offset long, length long"))


def read_warc(records: DataFrame, folder: str) -> DataFrame:
    """The records of WARC shards. A response's length and digest are taken from its payload and held against the
    record's own digest; a revisit's come from its stored HTTP head and its digest field."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ShardReader(folder) as source:
            for batch in batches:
                rows = []
                for shard, offset, length in zip(batch["shard"], batch["offset"], batch["length"], strict=True):
                    fields, block = parse_warc(gunzipped(source.read(shard, offset, length)))
                    head, payload = split_http(block)
                    page, digest, kind = http_field(head, "X-Page-Id"), fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
                    refers = fields.get("X-Refers-To-Page")
                    if kind == "response":
                        n = len(payload)
                        if sha1_base32(payload) != digest:
                            raise ValueError(f"the payload of {fields['WARC-Record-ID']} has another digest")
                    else:
                        n = int(http_field(head, "Content-Length"))
                    rows.append((int(page) if page else None, n, digest, kind, int(refers) if refers else None, fields["WARC-Record-ID"].strip("<>"), fields["WARC-Date"]))
                yield pd.DataFrame(rows, columns=[x.split()[0] for x in READ.split(", ")]).astype({"page_id": "Int64", "refers_to": "Int64"})

    return _by_shard(records).mapInPandas(task, READ)


def op2_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as ARC archives, converted to WARC archives, and read back from these.

    Null html is an empty payload; a null url is written as ``unknown:``; rows with a null page_id come back with a null
    page_id; repeated rows are records of their own. An empty table gives an empty result. Other columns are not read.
    """
    root = shared_dir(spark)
    arc, warc = f"{root}/arc", f"{root}/warc"
    for folder in (arc, warc):
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
    records = scan_arc(write_arc(table(spark, sf_dir, "pages"), arc), arc)
    listed = write_warc(resolve(records), arc, warc)
    return read_warc(listed, warc)
