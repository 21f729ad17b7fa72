"""WARC archives: a writer, a normaliser of whole-file gzip streams, and an indexed reader.

The writer makes one gzip stream per file, as many crawlers do. The normaliser inflates
that stream once, in pieces, and rewrites every record as a gzip member of its own next to a
sidecar index of (page, offset, length), so that any record can be read alone.

Records with equal payloads of at least LEAST_PAYLOAD bytes: the one with the largest
page_id is a response, the others are revisits of it. Smaller payloads are all responses.

Cases: null html is an empty payload; a null or odd url is written percent-encoded (null:
an empty target); a null page_id is kept and loses to every other id, so copies whose ids
are all null are all responses; repeated rows of the largest id are all responses; an empty
table writes nothing and returns no row; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import ship_package
from .store import filesystem, fresh_dir, materialize, write_atomic

LEAST_PAYLOAD = 1000
SALTS = 16
CHUNK = 1 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit has the payload's digest and length but not the payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Target-URI: {quote(url or '', safe=_SAFE)}", "WARC-Date: 2024-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Profile: {PROFILE}", f"X-Refers-To-Page: {refers_to}"]
    head += [f"X-Page: {'' if page_id is None else page_id}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


_SAFE = "!#$&'()*+,/:;=?@[]%-._~"


def parse_head(raw: bytes) -> dict[str, str]:
    lines = raw.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def records(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Head and raw bytes of every record of an inflated stream; holds one record at a time."""
    buf, at = bytearray(), 0
    head: dict[str, str] | None = None
    need = 0
    for chunk in chunks:
        buf += chunk
        while True:
            if head is None:
                end = buf.find(b"\r\n\r\n", at)
                if end < 0:
                    break
                head = parse_head(bytes(buf[at:end]))
                need = end + 4 + int(head["content-length"]) + 4 - at
            if len(buf) - at < need:
                break
            yield head, bytes(buf[at : at + need])
            at, head = at + need, None
        if at:
            del buf[:at]
            at = 0
    if head is not None or buf.strip():
        raise ValueError("the archive ends inside a record")


def inflate(stream) -> Iterator[bytes]:
    """Inflated pieces of a gzip file of one or more members, read and held in pieces."""
    z = zlib.decompressobj(31)
    while raw := stream.read(CHUNK):
        while raw:
            yield z.decompress(raw, CHUNK)
            while z.unconsumed_tail:
                yield z.decompress(z.unconsumed_tail, CHUNK)
            raw = z.unused_data
            if z.eof:
                z = zlib.decompressobj(31)
            else:
                break
    if tail := z.flush():
        yield tail


def normalize(source: str, target: str) -> int:
    """Rewrite a monolithic archive with one gzip member a record; the index lies beside it
    under the name + ".idx", one JSON line a record: page, offset, length. Returns the records."""
    fs, path = filesystem(source)
    out_fs, out_path = filesystem(target)
    mine = f"{out_path}.{uuid.uuid4().hex}.tmp"
    index, at = [], 0
    with fs.open_input_stream(path, compression=None) as stream, out_fs.open_output_stream(mine, compression=None) as out:
        for head, raw in records(inflate(stream)):
            z = zlib.compressobj(6, zlib.DEFLATED, 31)
            member = z.compress(raw) + z.flush()
            out.write(member)
            index.append(json.dumps([int(head["x-page"]) if head.get("x-page") else None, at, len(member)]))
            at += len(member)
    out_fs.move(mine, out_path)
    write_atomic(f"{target}.idx", ["\n".join(index).encode()])
    return len(index)


def read_record(stream, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """Head and block of the record whose member lies at offset."""
    stream.seek(offset)
    raw = zlib.decompress(stream.read(length), 31)
    end = raw.index(b"\r\n\r\n")
    return parse_head(raw[:end]), raw[end + 4 : -4]


def decide(pages: DataFrame) -> DataFrame:
    """page_id, url, html, digest, refers_to. Groups of copies are added up before they are
    joined back, and the join's key is salted, so one common page is not one task."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.col("html").cast("binary"))).withColumn("size", F.octet_length("html"))
    groups = rows.where(F.col("size") >= LEAST_PAYLOAD).groupBy("digest", "size").agg(F.count("*").alias("n"), F.max("page_id").alias("first")).where("n > 1 and first is not null")
    groups = groups.select("digest", "size", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    # pages that are too small to match get salts that no group has, many of them: empty pages stay spread
    some = F.xxhash64("page_id", "url")
    rows = rows.withColumn("salt", F.when(F.col("size") >= LEAST_PAYLOAD, F.pmod(some, F.lit(SALTS))).otherwise(F.pmod(some, F.lit(1_000_000)) + SALTS).cast("int"))
    joined = rows.join(groups, ["digest", "size", "salt"], "left")
    return joined.select("page_id", "url", "html", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))


def write_archives(pages: DataFrame, file_bytes: int = 64 << 20) -> DataFrame:
    """Monolithic archives of all pages in shared storage; the manifest (path, n_records)."""
    spark = pages.sparkSession
    ship_package(spark)
    folder = fresh_dir(spark, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        z, parts, size, n, made = None, [], 0, 0, []

        def close() -> None:
            nonlocal z, parts, size, n
            path = f"{folder}/part-{part:06d}-{len(made):05d}.warc.gz"
            write_atomic(path, [*parts, z.flush()])
            made.append((path, n))
            z, parts, size, n = None, [], 0, 0

        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                for page, url, html, digest, ref in zip(*(batch.column(i)[lo : lo + 256].to_pylist() for i in range(5)), strict=True):
                    z = z or zlib.compressobj(6, zlib.DEFLATED, 31)
                    raw = record(page, url, html.encode(), digest, ref)
                    parts.append(z.compress(raw))
                    size, n = size + len(raw), n + 1
                    if size >= file_bytes:
                        close()
        if n:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.int64())], ["path", "n_records"])

    return materialize(decide(pages).mapInArrow(run, "path string, n_records long"), "warc-manifest")


def _spread(manifest: DataFrame) -> DataFrame:
    return manifest.select("path").repartition(max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def normalize_archives(manifest: DataFrame) -> DataFrame:
    """Normalise every archive of a manifest; the new manifest."""
    ship_package(manifest.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                target = path.removesuffix(".warc.gz") + ".members.warc.gz"
                n = normalize(path, target)
                yield pa.RecordBatch.from_arrays([pa.array([target]), pa.array([n], pa.int64())], ["path", "n_records"])

    return materialize(_spread(manifest).mapInArrow(run, "path string, n_records long"), "warc-normal")


def read_archives(manifest: DataFrame) -> DataFrame:
    """One row per record, read through the index, each member by itself."""
    ship_package(manifest.sparkSession)
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from urllib.parse import unquote

        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, name = filesystem(path)
                with fs.open_input_file(f"{name}.idx") as f:
                    index = [json.loads(x) for x in f.read().decode().split("\n") if x]
                rows = []
                with fs.open_input_file(name) as f:
                    for page, offset, length in index:
                        head, block = read_record(f, offset, length)
                        http, _, payload = block.partition(b"\r\n\r\n")
                        kind = head["warc-type"]
                        if kind == "response":
                            size, digest = len(payload), hashlib.sha1(payload).hexdigest()
                        else:
                            size, digest = int(http.rpartition(b":")[2]), head["warc-payload-digest"].partition(":")[2]
                        rows.append((page, unquote(head["warc-target-uri"]), size, digest, kind, int(head["x-refers-to-page"]) if kind == "revisit" else None))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)], ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return _spread(manifest).mapInArrow(run, schema)


OP5_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS payload_digest FROM p),
g AS (SELECT payload_digest, payload_bytes, max(page_id) AS first FROM d WHERE payload_bytes >= 1000 GROUP BY ALL HAVING count(*) > 1)
SELECT page_id, CAST(d.payload_bytes AS BIGINT) AS payload_bytes, d.payload_digest,
  CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM d LEFT JOIN g USING (payload_digest, payload_bytes)
"""


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return read_archives(normalize_archives(write_archives(pages))).drop("url")
