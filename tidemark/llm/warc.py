"""Converter from legacy ARC archives to WARC, and readers of both.

An ARC file begins with a version block that names its version's header line; each record is one such line, then
as many bytes as it declares. Version 1 has five fields, version 2 ten. A record becomes a WARC record with the target,
the date, an identifier made from target, date, head and digest (a rerun makes the same), the type and SHA-256
digests: an HTTP answer is a `response`, anything else (DNS answers, FTP files) a `resource`, and the version block a `warcinfo`
that the records name. Answers with a payload of at least `least` bytes that equals another's become `revisit` records of the one that comes first (by key, then date,
target and identifier), whose identifier, target and date are joined in.

Content stays bytes all the way. Header lines that aren't UTF-8 are read as Latin-1. Free style: Arrow batches parse the archives and write the records; which
records revisit which is decided by DataFrames from digests alone, so that no content moves by digest and no task holds a
group of copies. Archives are written with Spark's own writer into the shared folder, in files of bounded size, and each is unpacked as a stream.

Defined results: a null payload is empty, a null url is the empty target, rows that repeat (same key and payload)
share their identifier and type, a null key is the largest, ties in key go by date, target and identifier, payloads of any bytes and any length that fits a cell are kept whole,
an empty table gives no records, a header line that doesn't fit its version or a record shorter than it declares is an error.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import cut, new_path

#: The header line of each ARC version.
FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n\r\n"
#: A file ends with the record that fills it to so many records or bytes.
PER_FILE, FILE_BYTES = 1000, 32 << 20
RECORD = "key long, info string, target string, ip string, date string, media string, head binary, payload binary, digest string, size long, id string"


def told(data: bytes) -> str:
    """A header's text: UTF-8, or Latin-1 where it isn't that."""
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return data.decode("latin-1")


def parse_arc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of an ARC file as (header fields, content); the first is the version block, with the field Version beside the others."""
    head = data.find(b"\n")
    if head < 0:
        return
    first = told(data[:head]).split(" ")
    size = int(first[-1])
    block = data[head + 1 : head + 1 + size]
    version = int(block.split(b" ", 1)[0])
    if not first[0].startswith("filedesc://") or version not in FIELDS:
        raise ValueError(f"not an ARC file of a known version: {data[:80]!r}")
    names = FIELDS[version]
    yield {"URL": first[0], "IP-address": first[1], "Archive-date": first[2], "Content-type": first[3], "Version": str(version)}, block
    at = head + 1 + size
    while at < len(data):
        if data[at : at + 1] == b"\n":
            at += 1
            continue
        end = data.index(b"\n", at)
        # the URL may hold spaces in files of careless crawlers, the other fields don't
        values = told(data[at:end]).rsplit(" ", len(names) - 1)
        if len(values) != len(names):
            raise ValueError(f"a header line of version {version} has {len(values)} fields: {data[at:end][:200]!r}")
        fields = dict(zip(names, values, strict=True))
        size = int(fields["Archive-length"])
        if end + 1 + size > len(data):
            raise ValueError(f"a record is shorter than the {size} bytes that it declares")
        yield fields, data[end + 1 : end + 1 + size]
        at = end + 1 + size


def split_http(content: bytes) -> tuple[bytes, bytes] | None:
    """HTTP head (without its blank line) and payload; nothing if the content isn't an HTTP answer."""
    if not content.startswith(b"HTTP/"):
        return None
    head, _, payload = content.partition(b"\r\n\r\n")
    return head, payload


def http_fields(head: bytes) -> dict[str, str]:
    """The fields of an HTTP head by lower-case name; lines without a colon are left out."""
    pairs = (x.split(":", 1) for x in told(head).split("\r\n")[1:] if ":" in x)
    return {k.strip().lower(): v.strip() for k, v in pairs}


def warc_date(date: str) -> str:
    d = date.ljust(14, "0")
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(10).join(parts))}>"


def parsed(data: bytes) -> Iterator[tuple]:
    """The records of an ARC file as rows of RECORD. The version block comes first, with no target; head is null where content isn't HTTP."""
    info = None
    for fields, content in parse_arc(data):
        date = warc_date(fields["Archive-date"])
        if "Version" in fields:
            info = record_id(fields["URL"], date, hashlib.sha256(content).hexdigest())
            lines = f"software: tidemark\r\nformat: WARC File Format 1.1\r\nx-arc-version: {fields['Version']}\r\nx-arc-name: {fields['URL'].removeprefix('filedesc://')}\r\n"
            body = lines.encode()
            yield None, None, None, fields["IP-address"], date, "application/warc-fields", None, body, hashlib.sha256(body).hexdigest(), len(body), info
            continue
        http = split_http(content)
        head, payload = http or (None, content)
        digest = hashlib.sha256(payload).hexdigest()
        key = http_fields(head).get("x-record-key") if head is not None else None
        named = record_id(fields["URL"], date, digest, "" if head is None else told(head))
        media = "application/http; msgtype=response" if http else fields["Content-type"]
        yield int(key) if key and key.lstrip("-").isdigit() else None, info, fields["URL"], fields["IP-address"], date, media, head, payload, digest, len(payload), named


def warc_record(row: tuple, refers: tuple[str, str, str] | None) -> bytes:
    """A WARC record of a row of RECORD, without the end of record; refers: identifier, target and date of the record it revisits."""
    _, info, target, ip, date, media, head, payload, digest, _, name = row
    block = payload if head is None else head + END.encode() + (b"" if refers else payload)
    kind = "warcinfo" if target is None else "revisit" if refers else "resource" if head is None else "response"
    named = {"WARC-Type": kind}
    if target is not None:
        named["WARC-Target-URI"] = target
    named |= {"WARC-Date": date, "WARC-IP-Address": ip, "WARC-Record-ID": name, "WARC-Payload-Digest": f"sha256:{digest}", "Content-Type": media}
    if info:
        named["WARC-Warcinfo-ID"] = info
    if refers:
        named |= {"WARC-Profile": PROFILE, "WARC-Refers-To": refers[0], "WARC-Refers-To-Target-URI": refers[1], "WARC-Refers-To-Date": refers[2]}
    named["WARC-Block-Digest"] = f"sha256:{hashlib.sha256(block).hexdigest()}"
    named["Content-Length"] = str(len(block))
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in named.items()) + "\r\n").encode() + block


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of a WARC file, packed or not, as (named fields, block), one at a time."""
    file = gzip.GzipFile(fileobj=io.BytesIO(data)) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)
    while line := file.readline():
        if line == b"\r\n":
            continue
        if not line.startswith(b"WARC/1."):
            raise ValueError(f"not a WARC record: {line[:80]!r}")
        named: dict[str, str] = {}
        while (line := file.readline()) not in (b"\r\n", b""):
            name, _, value = told(line).partition(":")
            named[name.strip()] = value.strip()
        block = file.read(size := int(named["Content-Length"]))
        if len(block) < size:
            raise ValueError(f"a record is shorter than the {size} bytes that it declares")
        yield named, block


def arc_of(pages: DataFrame, key: str = "page_id", url: str = "url", body: str = "html", date: str = "20240101000000") -> DataFrame:
    """Pages as ARC files of one record each, both versions by turns, with the key as an HTTP field. A test source for the converter."""
    text = F.coalesce(F.col(f"`{body}`"), F.lit(""))
    size = F.octet_length(text)
    target = F.coalesce(F.regexp_replace(F.col(f"`{url}`"), "[\\r\\n]", ""), F.lit(""))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Record-Key: "), F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")), F.lit("\r\nContent-Length: "), size.cast("string"), F.lit(END))
    length = F.octet_length(head) + size

    def file(version: int, line: Column) -> Column:
        desc = f"{version} 0 tidemark\n{' '.join(FIELDS[version])}\n"
        tail = f"text/plain {len(desc)}" if version == 1 else f"text/plain 200 - - 0 pages.arc {len(desc)}"
        return F.concat(F.lit(f"filedesc://pages.arc 0.0.0.0 {date} {tail}\n{desc}"), line, length.cast("string"), F.lit("\n"), head, text, F.lit("\n"))

    one = F.concat(target, F.lit(f" 0.0.0.0 {date} text/html "))
    two = F.concat(target, F.lit(f" 0.0.0.0 {date} text/html 200 - - 0 pages.arc "))
    arc = F.when(F.pmod(F.coalesce(F.col(f"`{key}`"), F.lit(0)), F.lit(2)) == 0, file(1, one)).otherwise(file(2, two))
    return pages.select(F.encode(arc, "utf-8").alias("arc"))


def records(arcs: DataFrame, arc: str = "arc", content: bool = True) -> DataFrame:
    """The records of ARC files (a binary column), one row each; without content, payloads are empty."""
    import pyarrow as pa

    names = [x.strip().split(" ")[0] for x in RECORD.split(",")]
    types = [{"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[x.strip().split(" ")[1]] for x in RECORD.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        for batch in batches:
            rows, held = [], 0
            for k in range(batch.num_rows):
                for row in parsed(batch.column(0)[k].as_py() or b""):
                    rows.append(row if content else (*row[:7], b"", *row[8:]))
                    held += len(rows[-1][7])
                    if len(rows) >= PER_FILE or held >= FILE_BYTES:
                        yield packed(rows)
                        rows, held = [], 0
            if rows:
                yield packed(rows)

    return arcs.select(F.col(f"`{arc}`").alias("arc")).mapInArrow(run, RECORD)


def revisits(found: DataFrame, least: int = 100) -> DataFrame:
    """(__id, of, of_target, of_date): for each answer of at least `least` bytes that isn't the first with its payload, the first one's identifier, target and date."""
    each = found.filter(F.col("head").isNotNull() & (F.col("size") >= least)).select("id", "digest", F.struct(F.col("key").isNull().alias("last"), "key", "date", "target", "id").alias("order"))
    first = each.groupBy("digest").agg(F.min("order").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("digest").alias("__digest"), "first")
    joined = each.join(first, F.col("digest") == F.col("__digest")).filter(F.col("id") != F.col("first.id"))
    return joined.select(F.col("id").alias("__id"), F.col("first.id").alias("of"), F.col("first.target").alias("of_target"), F.col("first.date").alias("of_date")).distinct()


def convert(arcs: DataFrame, arc: str = "arc", least: int = 100, info: bool = True) -> DataFrame:
    """ARC files to WARC records (value: bytes without the end of record), with a warcinfo record for each file if info."""
    import pyarrow as pa

    found = records(arcs, arc)
    if not info:
        found = found.filter(F.col("target").isNotNull()).withColumn("info", F.lit(None).cast("string"))
    # archives are parsed twice, which is cheaper than to store their content once more
    joined = found.join(revisits(records(arcs, arc, content=False), least), F.col("id") == F.col("__id"), "left").drop("__id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = zip(*(part.column(k).to_pylist() for k in range(part.num_columns)), strict=True)
                out = [warc_record(row[:-3], row[-3:] if row[-3] is not None else None) for row in rows]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    return joined.mapInArrow(run, "value binary")


def write(found: DataFrame, path: str | None = None) -> str:
    """Records as gzip-packed WARC files of bounded size under path (a new shared folder if none); returns it."""
    import pyarrow as pa

    path = path or new_path(found.sparkSession, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for k in range(batch.num_rows):
                held.append(batch.column(0)[k].as_py())
                size += len(held[-1])
                if len(held) >= PER_FILE or size >= FILE_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array([END.encode().join(held)], pa.binary())], names=["value"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([END.encode().join(held)], pa.binary())], names=["value"])

    # the cast doesn't touch the bytes, and the writer writes them as they are
    files = found.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
    files.write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", 1).text(path)
    return path


def read(spark: SparkSession, path: str, files: str = "part-*") -> DataFrame:
    """The records of WARC files: type, id, target, date, HTTP fields (by lower-case name), payload size (of what the record holds), payload digest, id of the record revisited.

    Digests are checked against what the record holds; where a file names none, the payload's SHA-256 stands. Digests other than SHA-256 are kept unchecked.
    """
    import pyarrow as pa

    schema = "record_type string, record_id string, target string, date string, http map<string,string>, payload_bytes long, payload_digest string, refers_to_id string"
    text = pa.string()
    types = (text, text, text, text, pa.map_(text, text), pa.int64(), text, text)

    def row(named: dict[str, str], block: bytes) -> tuple:
        http = split_http(block) if named.get("Content-Type", "").startswith("application/http") else None
        payload = http[1] if http else block
        kind, digest = named["WARC-Type"], named.get("WARC-Payload-Digest")
        own = hashlib.sha256(payload).hexdigest()
        if kind != "revisit" and digest and digest.startswith("sha256:") and digest != f"sha256:{own}":
            raise ValueError(f"the payload of {named['WARC-Record-ID']} doesn't have its digest")
        return kind, named["WARC-Record-ID"], named.get("WARC-Target-URI"), named.get("WARC-Date"), list(http_fields(http[0]).items()) if http else None, len(payload), digest.removeprefix("sha256:") if digest else own, named.get("WARC-Refers-To")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f"c{k}" for k in range(len(types))]
        for batch in batches:
            for k in range(batch.num_rows):
                rows = []
                for named, block in parse_warc(batch.column(0)[k].as_py()):
                    rows.append(row(named, block))
                    if len(rows) >= PER_FILE:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    found = spark.read.format("binaryFile").option("pathGlobFilter", files).load(path).select("content")
    return found.mapInArrow(run, schema)


def resolved(found: DataFrame) -> DataFrame:
    """The records that read gives, with __of: the record that a revisit names (its id, HTTP fields and payload size), null for others. Copies of a record stand for one."""
    first = found.filter("record_type = 'response'").groupBy("record_id").agg(F.min("payload_bytes").alias("n"), F.min(F.col("http")["x-record-key"]).alias("key"))
    # cut, so that the join reads two plain exchanges and Spark can split a record that many others revisit
    first = cut(first.select(F.col("record_id").alias("__record"), F.struct(F.col("record_id").alias("id"), "key", F.col("n").alias("payload_bytes")).alias("__of")))
    return found.join(first, F.col("refers_to_id") == F.col("__record"), "left").drop("__record")
