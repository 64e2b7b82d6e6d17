"""Deterministic sharded WARC writer and reader.

Write (``write_archives``): records are ranged by ``page_id`` with splitters
from a hash sample, so the same rows always give the same shards; each task
sorts its shards (external sort), regenerates every header and digest, and
writes one gzip member per record.  A file is rolled when its compressed size
reaches ``roll_bytes``.  Files are written under a temporary name and renamed
when complete; their names follow from shard and number, so a repeated task
writes the same file again.  The manifest, one row per file, is written last by
Spark's own committer; a folder without it is not an archive.

Among records with equal payloads of at least ``MIN_REVISIT`` bytes the one
with the largest ``page_id`` is the response and the others are revisits of it.
The decisions travel to the shards as rows of their own next to the records, so
payloads are shuffled once; the join that finds them is salted.

Read (``read_archives``): archives are read as whole files of bounded size and
parsed record by record; digests of responses are recomputed and compared, and
the number of records must equal the manifest's.

Files go through ``pyarrow.fs``, which reaches local and shared mounts, HDFS
and object stores by their address.

Edge cases: a null payload is empty; a null url leaves its header out, and line
breaks in one are percent-encoded; rows without ``page_id`` are responses;
repeated rows of the largest ``page_id`` are all responses; an empty table
gives a manifest without files.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
import zlib
from gzip import GzipFile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablework.llm.common import chunks, range_number, range_splitters

MIN_REVISIT = 1000
SHARD_BYTES = 32 << 20
ROLL_BYTES = 8 << 20
SALT = 32
DATE = "1970-01-01T00:00:00Z"  # fixed, so that equal input gives equal files
LEVEL = 6
SUFFIX = ".warc.gz"

MANIFEST = "shard int, file string, records long, bytes long, sha256 string"
RECORD = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long, file string"
_KEY = "struct<i:bigint,d:string>"


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record(headers: list[tuple[str, object]], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", len(block))] if v is not None)
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: str, target: int | None, target_url: str | None) -> bytes:
    """A response or, with ``target``, a revisit record; ``digest`` is the
    payload's SHA-1 in hex."""
    clean = lambda u: None if u is None else u.replace("\r", "%0D").replace("\n", "%0A")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if target is not None else http + payload
    headers: list[tuple[str, object]] = [
        ("WARC-Type", "response" if target is None else "revisit"),
        ("WARC-Record-ID", record_id(page_id, digest)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", clean(url)),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()),
        ("WARC-Block-Digest", _sha1(block)),
        ("X-Page-ID", page_id),
    ]
    if target is not None:
        headers += [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("WARC-Refers-To", record_id(target, digest)),
            ("WARC-Refers-To-Target-URI", clean(target_url)),
            ("WARC-Refers-To-Date", DATE),
            ("X-Refers-To-Page-ID", target),
        ]
    return _record(headers, block)


class ArchiveFile:
    """One archive under a temporary name until ``commit``."""

    def __init__(self, fs, folder: str, shard: int, number: int):
        self.fs, self.name = fs, f"pages-{shard:06d}-{number:05d}{SUFFIX}"
        self.shard, self.records, self.bytes, self.sha = shard, 0, 0, hashlib.sha256()
        self.final = f"{folder}/{self.name}"
        self.temporary = f"{folder}/.{self.name}.{uuid.uuid4().hex}.open"
        self.out = fs.open_output_stream(self.temporary)
        info = f"software: tablework\r\nformat: WARC File Format 1.1\r\nshard: {shard}\r\npart: {number}\r\n".encode()
        self._write(_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(None, self.name)), ("WARC-Date", DATE), ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields"), ("WARC-Block-Digest", _sha1(info))], info))

    def _write(self, record: bytes) -> None:
        z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)  # a gzip member without a time
        member = z.compress(record) + z.flush()
        self.out.write(member)
        self.sha.update(member)
        self.bytes += len(member)

    def add(self, record: bytes) -> None:
        self._write(record)
        self.records += 1

    def commit(self) -> dict[str, object]:
        self.out.close()
        self.fs.move(self.temporary, self.final)
        return {"shard": self.shard, "file": self.name, "records": self.records, "bytes": self.bytes, "sha256": self.sha.hexdigest()}


def _file_system(address: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(address if "://" in address or address.startswith("/") else address.replace(":", "://", 1))


def revisits(facts: DataFrame, salt: int = SALT) -> DataFrame:
    """(i, d, target, target_url) of the records that repeat another's payload:
    ``facts`` has i (page id), d (digest), n (bytes), url."""
    large = facts.where((F.col("n") >= MIN_REVISIT) & F.col("i").isNotNull())
    groups = large.groupBy("d").agg(F.count(F.lit(1)).alias("copies"), F.max(F.struct("i", "url")).alias("top")).where("copies > 1")
    spread = groups.select("d", "top", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))).alias("s"))
    salted = large.select("i", "d", F.pmod(F.xxhash64("i"), F.lit(salt)).cast("int").alias("s"))
    return salted.join(spread, ["d", "s"]).where(F.col("i") < F.col("top.i")).select("i", "d", F.col("top.i").alias("target"), F.col("top.url").alias("target_url")).distinct()


def write_archives(pages: DataFrame, folder: str, shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Write ``pages`` (page_id, url, html) below ``folder``; the manifest."""
    spark = pages.sparkSession
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("i"), F.col("url").cast("string").alias("url"), payload.alias("text"))
    keyed = rows.select("i", F.sha1("text").alias("d"), "url", "text")
    facts = keyed.select("i", "d", "url", F.octet_length("text").alias("n"))
    n_rows, total = facts.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    key = F.struct("i", "d")
    borders = range_splitters(facts, key, ["i", "d"], -(-total // shard_bytes), n_rows)
    shard = range_number(borders, _KEY, key).alias("shard")
    records = keyed.select(shard, "i", "d", F.lit(1).alias("kind"), "url", "text", F.lit(None).cast("long").alias("target"))
    decisions = revisits(facts).select(shard, "i", "d", F.lit(0).alias("kind"), F.col("target_url").alias("url"), F.lit(None).cast("binary").alias("text"), "target")
    ordered = records.unionByName(decisions).repartition("shard").sortWithinPartitions("shard", "i", "d", "kind", "url")
    place = f"{folder}/data"

    def write(batches):
        fs, path = _file_system(place)
        fs.create_dir(path, recursive=True)
        done, archive, decision = [], None, None
        for part, texts in chunks(batches):
            cols = [part.column(c).to_pylist() for c in ("shard", "i", "d", "kind", "url", "target")]
            for shard, i, d, kind, url, target, text in zip(*cols, texts, strict=True):
                if kind == 0:
                    decision = (i, d, target, url)
                    continue
                if archive is not None and (archive.shard != shard or archive.bytes >= roll_bytes):
                    done.append((archive.commit(), archive.shard))
                    archive, number = None, (number + 1 if done[-1][1] == shard else 0)
                elif archive is None:
                    number = 0
                archive = archive or ArchiveFile(fs, path, shard, number)
                hit = decision is not None and decision[:2] == (i, d)
                archive.add(page_record(i, url, text, d, decision[2] if hit else None, decision[3] if hit else None))
        if archive is not None:
            done.append((archive.commit(), archive.shard))
        yield pa.RecordBatch.from_pylist([x for x, _ in done], schema=pa.schema([("shard", pa.int32()), ("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())]))

    ordered.mapInArrow(write, MANIFEST).write.parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def parse(stream) -> "list[tuple[dict[str, str], bytes]]":
    """(headers, block) of each record of an uncompressed stream, in turn."""
    while line := stream.readline():
        if line != b"WARC/1.1\r\n":
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        headers = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode().partition(": ")
            headers[name] = value.rstrip("\r\n")
        block = stream.read(int(headers["Content-Length"]))
        if stream.read(4) != b"\r\n\r\n":
            raise ValueError("a WARC record ends early")
        yield headers, block


def page_row(headers: dict[str, str], block: bytes) -> dict[str, object]:
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = base64.b32decode(headers["WARC-Payload-Digest"].partition(":")[2]).hex()
    size = int(http.rpartition(b"Content-Length: ")[2])
    revisit = headers["WARC-Type"] == "revisit"
    if headers["WARC-Block-Digest"] != _sha1(block) or not revisit and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != size):
        raise ValueError(f"digest mismatch in {headers['WARC-Record-ID']}")
    number = lambda name: int(headers[name]) if name in headers else None
    return {"page_id": number("X-Page-ID"), "url": headers.get("WARC-Target-URI"), "payload": None if revisit else payload, "payload_bytes": size, "payload_digest": digest, "record_type": headers["WARC-Type"], "refers_to": number("X-Refers-To-Page-ID")}


def read_archives(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """One row per page record of the archives below ``folder``."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")  # missing: not committed
    if manifest.isEmpty():
        return spark.createDataFrame([], RECORD)
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{SUFFIX}").load(f"{folder}/data").select("path", "content")
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(RECORD))

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                rows, name = [], path.rpartition("/")[2]
                with GzipFile(fileobj=io.BytesIO(content.as_buffer())) as stream:
                    for headers, block in parse(io.BufferedReader(stream, 1 << 20)):
                        if headers["WARC-Type"] != "warcinfo":
                            row = page_row(headers, block) | {"file": name}
                            rows.append(row if payloads else row | {"payload": None})
                        if len(rows) >= 512:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows = []
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return files.mapInArrow(run, RECORD)


def verify(records: DataFrame, folder: str) -> None:
    """Raise unless the archives hold as many records as the manifest says."""
    spark = records.sparkSession
    wanted = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").agg(F.coalesce(F.sum("records"), F.lit(0))).first()[0]
    found = records.count()
    if wanted != found:
        raise ValueError(f"{folder}: the manifest has {wanted} records, the archives {found}")
