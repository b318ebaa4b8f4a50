"""Web archives, index first: records are written with an index of (file, offset, length, URL, digest), and selected
records are read back by sorted, coalesced byte ranges.

Records are separate gzip members, so that each can be read by its byte range alone. Of pages with equal payloads the one
with the largest page_id is a response; the others are revisits that refer to it and hold no payload. Files are named by
task attempt and the index only lists files of attempts that succeeded, so a lost executor leaves no wrong record.

Payloads stay where they are read if no other page has them; of a group of copies only the page that becomes the response
carries its payload through the join that tells which one that is.

Defined results: null html is an empty payload, a null url becomes a urn of the page; rows repeated with one page_id and
payload are all responses, or all revisits of the same response; a page without page_id never is referred to unless
its whole group has none (then all its pages are responses). An empty table gives an empty archive; payloads of any
length are written whole; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import common
from tessella.shipping import map_arrow

RANGE, GAP, ROLL = 8 << 20, 64 << 10, 1 << 30
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "page_id long, url string, file string, offset long, length long, record_type string, payload_digest string, refers_to long"
_INDEX = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("record_type", pa.string()), ("payload_digest", pa.string()), ("refers_to", pa.int64())])


def digest32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def _urn(page_id: int | None) -> str:
    return f"urn:tessella:page:{'' if page_id is None else page_id}"


def build_record(page_id: int | None, url: str, size: int, payload: bytes, refers_to: int | None, response: bool, digest: str) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + payload if response else http
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if response else 'revisit'}",
        f"WARC-Record-ID: <{_urn(page_id)}>",
        f"WARC-Target-URI: {url}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if not response:
        head += [f"WARC-Refers-To: <{_urn(refers_to)}>", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and the block of one uncompressed record."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    return headers, rest[: int(headers["content-length"])]


def kinds(pages: DataFrame) -> DataFrame:
    """page_id, url, size, sha1, payload (null for revisits), refers_to (its own page_id for a response)."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    page = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    page = page.select("page_id", "url", F.length("payload").cast("long").alias("size"), F.sha1("payload").alias("sha1"), "payload", F.sha2("payload", 256).alias("same"))
    copies = page.groupBy("same").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1")
    copies = common.written(copies, "warc-copies")
    marked, shared = common.sieve(page, F.col("same"), copies.select("same"))
    alone = marked.where(~F.col(shared)).select("page_id", "url", "size", "sha1", "payload", F.col("page_id").alias("refers_to"))
    # what the sieve lets through needs its payload only as a response, or where it has no copy after all
    single = common.written(marked.where(shared).select("same").distinct().join(copies, "same", "left_anti"), "warc-singles")
    near, chosen = common.sieve(marked.where(shared).drop(shared), F.xxhash64("page_id", "same"), copies.select(F.xxhash64("refers_to", "same")))
    near, kept = common.sieve(near, F.col("same"), single)
    near = near.withColumn("payload", F.when(F.col(chosen) | F.col(kept), F.col("payload"))).drop(chosen, kept)
    total = copies.agg(F.sum("n")).first()[0] or 0
    tied = common.lookup(near, ["same"], copies, "n", total).withColumn("refers_to", F.when(F.col("n").isNull(), F.col("page_id")).otherwise(F.col("refers_to")))
    tied = tied.withColumn("payload", F.when(F.col("page_id").eqNullSafe(F.col("refers_to")), F.col("payload")))
    return alone.unionByName(tied.select(alone.columns))


def write(pages: DataFrame, folder: str, level: int = 1) -> DataFrame:
    """Write one record per row of pages (page_id, url, html) under folder; returns the index, itself written there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = pafs.FileSystem.from_uri(folder)
        fs.create_dir(at, recursive=True)
        task, part, out, name, offset = TaskContext.get(), 0, None, "", 0
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                page_id, url, size, sha1, payload, refers_to = (batch.column(c)[i].as_py() for c in range(6))
                if out is None or offset > ROLL:
                    if out is not None:
                        out.close()
                    name, offset = f"{task.partitionId():06d}-{task.taskAttemptId()}-{part}.warc.gz", 0
                    out, part = fs.open_output_stream(f"{at}/{name}", compression=None), part + 1
                url = (url if url is not None else _urn(page_id)).replace("\r", "%0D").replace("\n", "%0A")
                response = page_id == refers_to
                digest = digest32(bytes.fromhex(sha1))
                packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                member = packer.compress(build_record(page_id, url, size, payload, refers_to, response, digest)) + packer.flush()
                out.write(member)
                rows.append((page_id, url, name, offset, len(member), "response" if response else "revisit", digest, None if response else refers_to))
                offset += len(member)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _INDEX, strict=True)] if rows else [pa.array([], f.type) for f in _INDEX], schema=_INDEX)
        if out is not None:
            out.close()

    index = kinds(pages).transform(map_arrow, run, INDEX)
    index.write.parquet(f"{folder}/index")
    return pages.sparkSession.read.parquet(f"{folder}/index")


def read(selected: DataFrame, folder: str) -> DataFrame:
    """Read the records of the selected index rows: page_id, url, record_type, payload (null for revisits), payload_digest,
    refers_to. Neighbouring records come in by one read of up to RANGE bytes; digests are checked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = pafs.FileSystem.from_uri(folder)
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload", pa.binary()), ("payload_digest", pa.string()), ("refers_to", pa.int64())])

        def fetch(file: str, wanted: list[tuple[int, int]]) -> pa.RecordBatch:
            begin = wanted[0][0]
            with fs.open_input_file(f"{at}/{file}") as f:
                data = f.read_at(wanted[-1][0] + wanted[-1][1] - begin, begin)
            rows = []
            for offset, length in wanted:
                headers, block = parse_record(zlib.decompress(data[offset - begin : offset - begin + length], 31))
                kind, digest = headers["warc-type"], headers["warc-payload-digest"].removeprefix("sha1:")
                page, refers = (headers.get(h, "").strip("<>").rpartition(":")[2] for h in ("warc-record-id", "warc-refers-to"))
                payload = block.partition(b"\r\n\r\n")[2] if kind == "response" else None
                if payload is not None and digest32(hashlib.sha1(payload).digest()) != digest:
                    raise ValueError(f"payload of page {page} doesn't match its digest")
                rows.append((int(page) if page else None, headers["warc-target-uri"], kind, payload, digest, int(refers) if refers else None))
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        file, wanted = None, []
        for batch in batches:
            for f, offset, length in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True):
                if wanted and (f != file or offset > wanted[-1][0] + wanted[-1][1] + GAP or offset + length - wanted[0][0] > RANGE):
                    yield fetch(file, wanted)
                    wanted = []
                file = f
                wanted.append((offset, length))
        if wanted:
            yield fetch(file, wanted)

    stretch = F.floor(F.col("offset") / RANGE)
    ranges = selected.select("file", "offset", "length", stretch.alias("stretch")).repartition("file", "stretch").sortWithinPartitions("file", "offset")
    return ranges.select("file", "offset", "length").transform(map_arrow, run, "page_id long, url string, record_type string, payload binary, payload_digest string, refers_to long")


def round_trip(pages: DataFrame, folder: str) -> DataFrame:
    """Write and read back all pages: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    got = read(write(pages, folder), folder)
    got = common.written(got.select("page_id", "record_type", F.length("payload").cast("long").alias("payload_bytes"), "payload_digest", "refers_to"), "warc-read")
    key = ["refers_to", "payload_digest"]
    own, revisits = got.where("record_type = 'response'"), got.where("record_type = 'revisit'").drop("payload_bytes")
    sizes = own.groupBy(F.col("page_id").alias("refers_to"), "payload_digest").agg(F.max("payload_bytes").alias("payload_bytes"))
    met = common.written(revisits.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).join(sizes, key), "warc-met")
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return own.select(names).unionByName(common.lookup(revisits, key, met, "n", revisits.count()).select(names))
