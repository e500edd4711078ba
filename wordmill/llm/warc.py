"""WARC archives: a deterministic sharded writer, and a reader.

Rows are range-sorted by page id (and payload digest) into shards; each shard's records are written one after another as
gzip members, and a new file starts where one has reached ROLL compressed bytes. The shards' bounds come from a sample
that a hash of the id picks, so they depend on the rows only, not on how they are partitioned. Headers and digests are
regenerated from the payload: equal input gives equal files. A file is written under a temporary name of its own and renamed when complete; tasks that
run again after a lost executor write the same bytes again. Readers only see files that the manifest lists, and the
manifest (with byte range, size and digest of each stretch of records) is itself committed last, by rename.

Of records with equal payloads of at least MIN_REVISIT bytes, that with the largest page id is the response and the others
are revisits without payload; smaller payloads are all responses.

Defined results: null html is an empty payload; null url leaves the target out; a null page id is a response of its own;
rows repeated with one id are all written, and where that id is the largest they are all responses; an empty table gives an
empty archive with an empty manifest; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, keep_path, materialize, table, work_path

MIN_REVISIT, ROLL, LEVEL, STRETCH, SHARD = 1000, 32 << 20, 3, 4 << 20, 16 << 20
MOST_SHARDS, SAMPLED = 65_536, 16
DATE = "2024-01-01T00:00:00Z"
#: Fixed value: the profile of a revisit by digest in the WARC 1.1 standard.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SPACE = 0x776F7264_6D69_8C6C
MANIFEST = "file string, offset bigint, size bigint, records bigint, first_page bigint, last_page bigint, sha256 string"


# ------------------------------------------------------------------ records


def record_id(page: int | None, url: str | None = None) -> str:
    """A UUID that carries the page id; without id, one made from the url."""
    if page is None:
        return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, url or '')}>"
    return f"<urn:uuid:{uuid.UUID(int=_SPACE << 64 | page & (1 << 64) - 1)}>"


def _clean(url: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def write_record(page: int | None, url: str | None, payload: bytes, refers_to: int | None = None) -> bytes:
    """One record, uncompressed."""
    digest = "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    body = http + payload if refers_to is None else http
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page, url)}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_clean(url)}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Refers-To-Page: {refers_to}"]
    if page is not None:
        lines.append(f"WARC-Page-ID: {page}")
    lines += [
        f"WARC-Payload-Digest: {digest}",
        f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(body).digest()).decode()}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(body)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def member(record: bytes, level: int = LEVEL) -> bytes:
    """A gzip member without time or name, so equal records give equal bytes."""
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress(record) + c.flush()


def read_members(raw: bytes) -> Iterator[bytes]:
    while raw:
        d = zlib.decompressobj(31)
        out = d.decompress(raw)
        if not d.eof:
            raise ValueError("gzip member is cut off")
        yield out
        raw = d.unused_data


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers with lower-case names, block) of each record of uncompressed bytes."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        first, *lines = data[at:end].decode("utf-8").split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError("not a WARC record")
        headers: dict[str, str] = {}
        last = ""
        for line in lines:
            if line[:1] in " \t" and last:
                headers[last] += " " + line.strip()
                continue
            name, _, value = line.partition(":")
            last = name.strip().lower()
            headers[last] = value.strip()
        size = int(headers["content-length"])
        block = data[end + 4 : end + 4 + size]
        if len(block) != size or data[end + 4 + size : end + 8 + size] != b"\r\n\r\n":
            raise ValueError("record is cut off")
        yield headers, block
        at = end + 8 + size


def payload_of(headers: dict[str, str], block: bytes) -> tuple[int, str, bytes | None]:
    """(size and SHA-1 of the full payload, the payload if it is there); digests are checked."""
    if headers.get("warc-block-digest") != "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode():
        raise ValueError("block digest differs")
    http, _, payload = block.partition(b"\r\n\r\n")
    stated = base64.b32decode(headers["warc-payload-digest"].removeprefix("sha1:")).hex()
    if headers["warc-type"] == "revisit":
        size = next(int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
        return size, stated, None
    if hashlib.sha1(payload).hexdigest() != stated:
        raise ValueError("payload digest differs")
    return len(payload), stated, payload


# ------------------------------------------------------------------ files


def _open(path: str):
    """(file system, path on it): plain paths and any URI that pyarrow knows (file, hdfs, s3, gs)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def _writer(root: str, roll: int, level: int):
    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        context = TaskContext.get()
        files, base = _open(root)
        part, rows = None, []
        state = {"sink": None, "nth": 0}

        def close(stretches):
            state["sink"].close()
            files.move(state["tmp"], state["path"])
            rows.extend((state["name"], *s) for s in stretches)
            state["sink"] = None
            state["nth"] += 1

        stretches, now = [], None
        refers, key = None, None
        for batch in batches:
            for shard, page, digest, kind, refers_to, url, html in zip(*(c.to_pylist() for c in batch.columns)):
                if shard != part:
                    if state["sink"] is not None:
                        if now is not None:
                            stretches.append((*now[:5], now[5].hexdigest()))
                            now = None
                        close(stretches)
                    part, state["nth"] = shard, 0
                if kind == 0:  # the decision stands before the rows of its page and digest
                    refers, key = refers_to, (page, digest)
                    continue
                raw = member(write_record(page, url, html or b"", refers if key == (page, digest) else None), level)
                if state["sink"] is None:
                    state["name"] = f"part-{part:06d}-{state['nth']:05d}.warc.gz"
                    state["path"] = f"{base}/{state['name']}"
                    state["tmp"] = f"{base}/_tmp-{state['name']}-{context.taskAttemptId()}"
                    files.create_dir(base, recursive=True)
                    state["sink"], state["size"], stretches, now = files.open_output_stream(state["tmp"]), 0, [], None
                if now is None:
                    now = [state["size"], 0, 0, page, page, hashlib.sha256()]
                state["sink"].write(raw)
                state["size"] += len(raw)
                now[1] += len(raw)
                now[2] += 1
                now[4] = page
                now[5].update(raw)
                if now[1] >= STRETCH or state["size"] >= roll:
                    stretches.append((*now[:5], now[5].hexdigest()))
                    now = None
                    if state["size"] >= roll:
                        close(stretches)
        if state["sink"] is not None:
            if now is not None:
                stretches.append((*now[:5], now[5].hexdigest()))
            close(stretches)
        if rows:
            types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["file", "offset", "size", "records", "first_page", "last_page", "sha256"])

    return run


def revisits(pages: DataFrame) -> DataFrame:
    """page_id, digest, refers_to of the pages that revisit another; pages: page_id, digest, size.

    The largest id of each payload is found before anything is joined, so a payload that a third of the pages share is no
    hot key of the aggregate; the join carries ids only.
    """
    large = pages.where((F.col("size") >= MIN_REVISIT) & F.col("page_id").isNotNull())
    heads = large.groupBy("digest", "size").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("__least")).where("__least < refers_to")
    heads = heads.select(F.col("digest").alias("__d"), F.col("size").alias("__s"), "refers_to")
    return large.join(heads, (F.col("digest") == F.col("__d")) & (F.col("size") == F.col("__s"))).where("page_id < refers_to").select("page_id", "digest", "refers_to").distinct()


def shard_bounds(ids: DataFrame, size: int) -> tuple[list[int], int]:
    """(first ids of the second and later shards, number of shards) for shards of about `size` payload bytes.

    About SAMPLED ids for each shard come to the driver, and at most MOST_SHARDS shards are cut (from 1 TB on they grow;
    their rows are streamed, and files roll as ever).
    """
    total = ids.agg(F.sum("size").alias("s"), F.count("*").alias("n")).first()
    parts = max(1, min(MOST_SHARDS, -(-(total["s"] or 0) // size)))
    if parts == 1:
        return [], 1
    share = min(1.0, SAMPLED * parts / total["n"])
    some = ids.where(F.col("page_id").isNotNull() & (F.pmod(F.xxhash64("page_id"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1)).groupBy("page_id").agg(F.sum("size").alias("size")).collect()
    some = sorted((r["page_id"], r["size"]) for r in some)
    step, done, bounds = sum(n for _, n in some) / parts, 0, []
    for page, n in some:
        if done >= step * (len(bounds) + 1) and (not bounds or page > bounds[-1]):
            bounds.append(page)
        done += n
    return bounds[: parts - 1], parts


def write_archive(pages: DataFrame, root: str, roll: int = ROLL, level: int = LEVEL, shard: int = SHARD) -> DataFrame:
    """Writes pages (page_id, url, html) under root and returns the manifest, read from its file."""
    spark = pages.sparkSession
    html = F.coalesce(F.col("html").cast("binary"), F.lit("").cast("binary"))
    base = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", html.alias("html"))
    ids = materialize(base.select("page_id", F.sha1("html").alias("digest"), F.octet_length("html").cast("bigint").alias("size")), "warc-ids")
    decided = revisits(ids).select("page_id", "digest", F.lit(0).alias("kind"), "refers_to", F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("html"))
    rows = base.select("page_id", F.sha1("html").alias("digest"), F.lit(1).alias("kind"), F.lit(None).cast("bigint").alias("refers_to"), "url", "html")
    bounds, parts = shard_bounds(ids, shard)
    edges = np.array(bounds, np.int64)

    @F.pandas_udf("int")
    def place(page: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, page.fillna(0).to_numpy(np.int64), "right"))

    # rows without id are dealt by their digest, after all others
    number = F.when(F.col("page_id").isNull(), parts + F.pmod(F.crc32(F.col("digest").cast("binary")), F.lit(parts))).otherwise(place(F.coalesce("page_id", F.lit(0)))).cast("int")
    both = decided.union(rows).select(number.alias("shard"), "*")
    dealt = both.repartitionByRange(parts, "shard").sortWithinPartitions("shard", "page_id", "digest", "kind", "url")
    written = dealt.mapInArrow(_writer(root, roll, level), MANIFEST)
    temporary = f"{root}/_manifest-tmp"
    written.write.parquet(temporary)
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(temporary).getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.rename(path(temporary), path(f"{root}/_manifest")):
        raise RuntimeError("the manifest could not be committed")
    discard(ids)
    return read_manifest(spark, root)


def read_manifest(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"{root}/_manifest")


def read_archive(spark: SparkSession, root: str, with_payload: bool = False) -> DataFrame:
    """One row for each record that the manifest lists: page_id, url, payload_bytes, payload_digest, record_type, refers_to.

    Tasks read stretches of files, each checked against its digest in the manifest.
    """
    manifest = read_manifest(spark, root).select("file", "offset", "size", "sha256")
    count = manifest.count()
    width = max(1, min(count, int(spark.conf.get("spark.sql.shuffle.partitions"))))

    def run(batches):
        import pyarrow as pa

        types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
        files, base = _open(root)
        for batch in batches:
            for file, offset, size, digest in zip(*(c.to_pylist() for c in batch.columns)):
                with files.open_input_file(f"{base}/{file}") as source:
                    raw = source.read_at(size, offset)
                if hashlib.sha256(raw).hexdigest() != digest:
                    raise ValueError(f"{file} differs from its manifest")
                rows = []
                for one in read_members(raw):
                    for headers, block in parse_records(one):
                        n, sha, payload = payload_of(headers, block)
                        page, refers = headers.get("warc-page-id"), headers.get("warc-refers-to-page")
                        rows.append((int(page) if page else None, headers.get("warc-target-uri"), n, sha, headers["warc-type"], int(refers) if refers else None, payload))
                keep = 7 if with_payload else 6
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows))[:keep], types)], names[:keep])

    schema = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint" + (", payload binary" if with_payload else "")
    return manifest.repartition(width).mapInArrow(run, schema)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to an archive in the shared folder, and read back from it."""
    root = work_path(spark, "warc")
    keep_path(spark, root)
    write_archive(table(spark, sf_dir, "pages"), root)
    return read_archive(spark, root).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS raw FROM pages),
d AS (SELECT page_id, octet_length(raw) AS payload_bytes, sha1(raw) AS payload_digest FROM p),
m AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) ELSE page_id END AS head FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id < head THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < head THEN head END AS refers_to FROM m
"""
