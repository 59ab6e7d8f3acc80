r"""WARC: a deterministic sharded writer and a reader.

Records are range-sorted by page_id, and within one id by payload digest. The number of shards follows from the bytes
of the table; splitters are the keys of a sample chosen by hash (about `SAMPLE` keys a shard), so the same table gives
the same shards on any cluster. Rows find their shard by binary search of the splitters and travel by shard number, one
task a shard. A shard rolls to its next file when the compressed file passes `roll_bytes`; each file starts with a
warcinfo record. Each record is one gzip member with regenerated headers and SHA-256 digests. Every file is first
written under a temporary name of its task attempt and renamed; what a shard wrote is listed in its manifest, and when
all shards are done archive.json, again renamed into place, lists the shards and their records: an archive without it is
not complete, and a reader needs nothing else than the archive's URL. A retried or speculative task writes the same
bytes to the same names, so losing an executor is harmless; what dead attempts leave under temporary names goes at the
end.

Of records with equal payloads of at least `min_revisit` bytes the one with the smallest page_id is the
response, the others are revisits that name its record; smaller payloads are always responses. Record ids are UUIDs of a
digest of page, URL, payload, type and the number among equal rows, so no two records of an archive share one.

Cases: null html is an empty payload; null url an empty target; a null page_id sorts first, and loses to any
other page_id as the response of its payload; rows with equal page_id are ordered by payload digest and url
and each gets a record (of equal rows with the smallest id, one is the response). An empty table gives an
archive without shards. Other columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import math
import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import arrow_rows, fresh_path, slices
from .store import Folder

ROLL_BYTES = 64 << 20
MIN_REVISIT = 100
SAMPLE = 16
LEAST_SHARD, MOST_SHARD = 16 << 20, 1 << 30
_DATE = "2024-01-01T00:00:00Z"  # a fixed capture time: the tables have none, and the bytes must not change from run to run
_NO_ID = -(1 << 63)


def record_id(page_id: int | None, url: str | None, digest: str, kind: str, nth: int = 0) -> str:
    """The URI of a record; nth tells equal rows of one page apart."""
    key = json.dumps([page_id, url or "", digest, kind, nth])
    return f"<urn:uuid:{uuid.UUID(hashlib.sha256(key.encode()).hexdigest()[:32])}>"


def _one_line(url: str | None) -> str:
    return (url or "").replace("\r", "%0D").replace("\n", "%0A")


def _packed(head: dict[str, str], block: bytes) -> bytes:
    head |= {"WARC-Block-Digest": f"sha256:{hashlib.sha256(block).hexdigest()}", "Content-Length": str(len(block))}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def info_record(name: str) -> bytes:
    """The warcinfo record at the head of a file."""
    head = {"WARC-Type": "warcinfo", "WARC-Record-ID": record_id(None, name, "", "warcinfo"), "WARC-Date": _DATE, "WARC-Filename": name, "Content-Type": "application/warc-fields"}
    return _packed(head, b"software: quarrymill\r\nformat: WARC File Format 1.1\r\n")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None = None, refers_url: str | None = None, nth: int = 0, revisit: bool = False) -> bytes:
    """The uncompressed bytes of one WARC record; a revisit carries no payload, only its digest, length and the response's record."""
    kind = "revisit" if revisit else "response"
    head = {
        "WARC-Type": kind,
        "WARC-Record-ID": record_id(page_id, url, digest, kind, nth),
        "WARC-Date": _DATE,
        "WARC-Target-URI": _one_line(url),
        "WARC-Payload-Digest": f"sha256:{digest}",
        "WARC-Page-ID": "" if page_id is None else str(page_id),
    }
    if revisit:
        head |= {
            "WARC-Refers-To": record_id(refers_to, refers_url, digest, "response"),
            "WARC-Refers-To-Page-ID": "" if refers_to is None else str(refers_to),
            "WARC-Refers-To-Target-URI": _one_line(refers_url),
            "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
        }
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    return _packed(head | {"Content-Type": "application/http; msgtype=response"}, http + (b"" if revisit else payload))


def members(data: bytes) -> Iterator[bytes]:
    """The contents of the gzip members of a file, one by one."""
    at, piece = 0, 1 << 14  # fed in pieces: what a member leaves over is copied, so it has to be short
    view = memoryview(data)
    while at < len(data):
        z, out = zlib.decompressobj(31), []
        while not z.eof and at < len(data):
            fed = view[at : at + piece]
            out.append(z.decompress(fed))
            at += len(fed) - len(z.unused_data)
        yield b"".join(out)


def parse_record(raw: bytes) -> dict | None:
    """Headers and payload of a record, None for a warcinfo record; raises where a digest or a length doesn't hold."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)
    block = rest[: int(fields["Content-Length"])]
    if version != "WARC/1.1" or fields["WARC-Block-Digest"] != f"sha256:{hashlib.sha256(block).hexdigest()}" or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError(f"damaged record {fields.get('WARC-Record-ID')}")
    if fields["WARC-Type"] == "warcinfo":
        return None
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(next(x for x in http.decode().split("\r\n") if x.startswith("Content-Length: "))[16:])
    if fields["WARC-Type"] == "response" and (length != len(payload) or fields["WARC-Payload-Digest"] != f"sha256:{hashlib.sha256(payload).hexdigest()}"):
        raise ValueError(f"damaged payload {fields.get('WARC-Record-ID')}")
    return {
        "page_id": int(fields["WARC-Page-ID"]) if fields["WARC-Page-ID"] else None,
        "url": fields["WARC-Target-URI"],
        "payload": payload,
        "payload_bytes": length,
        "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha256:"),
        "record_type": fields["WARC-Type"],
        "record_id": fields["WARC-Record-ID"],
        "refers_to": int(fields["WARC-Refers-To-Page-ID"]) if fields.get("WARC-Refers-To-Page-ID") else None,
        "refers_to_record": fields.get("WARC-Refers-To"),
    }


def _rows(pages: DataFrame) -> DataFrame:
    """page_id, url, html and digest, nulls as documented."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    return rows.withColumn("digest", F.sha2("html", 256))


def copied_payloads(rows: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """page_id, url, digest and the response (first_id, first_url) of the pages whose large payload occurs more than once. No payload moves."""
    large = rows.where(F.octet_length("html") >= min_revisit).select("page_id", "url", "digest")
    order = F.struct(F.col("page_id").isNull().alias("none"), F.col("page_id").alias("id"), F.col("url").alias("url"))
    firsts = large.groupBy("digest").agg(F.count(F.lit(1)).alias("copies"), F.min(order).alias("first")).where("copies > 1")
    return large.join(firsts, "digest").select("page_id", "url", "digest", F.col("first.id").alias("first_id"), F.col("first.url").alias("first_url")).distinct()


def shard_bytes(total: int) -> int:
    """Bytes a shard stands for: a 4,096th of the table, between 16 MB and 1 GB."""
    return min(MOST_SHARD, max(LEAST_SHARD, total // 4096))


_KEY = np.dtype([("id", "<i8"), ("digest", "S64")])


def splitters(rows: DataFrame, shards: int, total: int) -> np.ndarray:
    """Sorted keys (id, digest) that cut the table into `shards` ranges, evenly spaced in a sample chosen by hash: about SAMPLE keys a shard reach the driver, whatever the table's size."""
    if shards < 2:
        return np.zeros(0, _KEY)
    share = min(1.0, SAMPLE * shards / max(total, 1))
    picked = F.pmod(F.xxhash64("page_id", "digest"), F.lit(1 << 32)) < F.lit(int(math.ceil(share * (1 << 32))))
    sample = rows.where(picked).select(F.coalesce("page_id", F.lit(_NO_ID)).alias("id"), "digest").distinct().toPandas()
    keys = np.sort(np.array(list(zip(sample["id"], sample["digest"], strict=True)), _KEY))
    return np.unique(keys[[len(keys) * k // shards for k in range(1, shards)]]) if len(keys) else keys


def _shard_column(cuts: np.ndarray):
    """A column function: the number of splitters at or before (page_id, digest), by binary search."""

    @F.pandas_udf("int")
    def shard(page_id: pd.Series, digest: pd.Series) -> pd.Series:
        key = np.empty(len(page_id), _KEY)
        key["id"], key["digest"] = page_id.to_numpy(), digest.to_numpy().astype("S64")
        return pd.Series(np.searchsorted(cuts, key, side="right").astype(np.int32))

    return shard(F.coalesce("page_id", F.lit(_NO_ID)), F.col("digest"))


def write(pages: DataFrame, url: str, roll_bytes: int = ROLL_BYTES, min_revisit: int = MIN_REVISIT, shards: int | None = None) -> dict:
    """Write the archive of `pages` under `url` and commit it; what archive.json says: records, files, bytes and the shards that have any.

    Only counts of each shard reach the driver."""
    spark = pages.sparkSession
    arrow_rows(spark)
    rows = _rows(pages)
    copied = copied_payloads(rows, min_revisit)
    size = pages.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(F.col("html").cast("string"))).alias("bytes")).first()
    shards = shards or max(1, -(-(size["bytes"] or 0) // shard_bytes(size["bytes"] or 0)))
    cuts = splitters(rows, shards, size["n"])
    shards = len(cuts) + 1

    # Payloads move once, to their shard; the notes on copies (kind 0) meet them there and come before their page.
    notes = copied.select(_shard_column(cuts).alias("shard"), "page_id", "digest", "url", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("html"), "first_id", "first_url")
    bodies = rows.select(_shard_column(cuts).alias("shard"), "page_id", "digest", "url", F.lit(1).alias("kind"), "html", F.lit(None).cast("long").alias("first_id"), F.lit(None).cast("string").alias("first_url"))
    ordered = bodies.unionByName(notes).repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "page_id", "digest", "url", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder, state = Folder(url), None

        def start():
            state["out"], state["n"] = io.BytesIO(), 0
            state["name"] = f"shard-{state['shard']:06d}-{len(state['files']):05d}.warc.gz"
            state["out"].write(gzip.compress(info_record(state["name"]), 6, mtime=0))

        def roll():
            data = state["out"].getvalue()
            folder.write(state["name"], data)
            state["files"].append({"name": state["name"], "bytes": len(data), "records": state["n"], "sha256": hashlib.sha256(data).hexdigest()})
            start()

        def finish():
            if state["n"]:
                roll()
            folder.write(_manifest(state["shard"]), json.dumps(state["files"], sort_keys=True).encode())
            sums = [sum(f[k] for f in state["files"]) for k in ("records", "bytes")]
            return pa.RecordBatch.from_pylist([{"shard": state["shard"], "files": len(state["files"]), "records": sums[0], "bytes": sums[1]}], schema=_SHARD)

        for batch in slices(batches, "html"):
            for r in batch.to_pylist():
                if state is None or state["shard"] != r["shard"]:
                    if state:
                        yield finish()
                    state = {"shard": r["shard"], "files": [], "note": None, "led": None, "key": None, "nth": 0}
                    start()
                key = (r["page_id"], r["digest"], r["url"])
                if r["kind"] == 0:
                    state["note"] = (key, r["first_id"], r["first_url"])
                    continue
                state["nth"] = state["nth"] + 1 if key == state["key"] else 0
                state["key"] = key
                refers, first_url, revisit = None, None, False
                if state["note"] and state["note"][0] == key:
                    _, first, first_url = state["note"]
                    # Of equal rows with the least id, which stand together here, the first one leads.
                    if (r["page_id"], r["url"]) == (first, first_url) and state["led"] != key:
                        state["led"] = key
                    else:
                        refers, revisit = first, True
                raw = record(r["page_id"], r["url"], r["html"].encode(), r["digest"], refers, first_url, state["nth"], revisit)
                state["out"].write(gzip.compress(raw, 6, mtime=0))
                state["n"] += 1
                if state["out"].tell() >= roll_bytes:
                    roll()
        if state:
            yield finish()

    done = sorted((r.asDict() for r in ordered.mapInArrow(run, "shard int, files long, records long, bytes long").collect()), key=lambda r: r["shard"])
    archive = {"records": sum(r["records"] for r in done), "files": sum(r["files"] for r in done), "bytes": sum(r["bytes"] for r in done), "shards": [r["shard"] for r in done]}
    if archive["records"] != size["n"]:
        raise RuntimeError(f"{archive['records']} records of {size['n']} pages written to {url}")
    folder = Folder(url)
    folder.write(ARCHIVE, json.dumps(archive, sort_keys=True).encode())
    folder.sweep()
    return archive


ARCHIVE = "archive.json"


def _manifest(shard: int) -> str:
    return f"manifest-{shard:06d}.json"


_SHARD = pa.schema([("shard", pa.int32()), ("files", pa.int64()), ("records", pa.int64()), ("bytes", pa.int64())])
_READ = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("record_id", pa.string()), ("refers_to", pa.int64()), ("refers_to_record", pa.string())])
_READ_SQL = "page_id long, url string, payload string, payload_bytes long, payload_digest string, record_type string, record_id string, refers_to long, refers_to_record string"


def read(spark: SparkSession, url: str, batch_bytes: int = 4 << 20) -> DataFrame:
    """The records of the archive under `url`, one task a shard; raises where the archive isn't complete or a file isn't what its manifest says."""
    archive = json.loads(Folder(url).read(ARCHIVE))
    shards = archive["shards"]

    def opened(batches):
        folder = Folder(url)
        for batch in batches:
            for at in batch.column("id").to_pylist():
                held, size = [], 0
                for f in json.loads(folder.read(_manifest(shards[at]))):
                    data = folder.read(f["name"])
                    if hashlib.sha256(data).hexdigest() != f["sha256"]:
                        raise ValueError(f"{f['name']} is not what its manifest says")
                    for raw in members(data):
                        found = parse_record(raw)
                        if found is None:
                            continue
                        held.append(found | {"payload": found["payload"].decode() if found["record_type"] == "response" else None})
                        size += len(raw)
                        if size >= batch_bytes:
                            yield pa.RecordBatch.from_pylist(held, schema=_READ)
                            held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema=_READ)

    return spark.range(0, len(shards), 1, max(1, len(shards))).mapInArrow(opened, _READ_SQL)


def round_trip(pages: DataFrame, url: str | None = None, **options) -> DataFrame:
    """Write the archive, commit it, and read every record back."""
    url = url or fresh_path(pages.sparkSession, "warc")
    write(pages, url, **options)
    return read(pages.sparkSession, url)


ORACLE_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
q AS (SELECT *, CASE WHEN payload_bytes >= {MIN_REVISIT} THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first_id FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
  CASE WHEN first_id IS NULL OR first_id = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first_id IS NULL OR first_id = page_id THEN NULL ELSE first_id END AS refers_to
FROM q"""
