"""Deterministic sharded WARC writer and reader.

Records are range-sorted by id into shards of about equal size; a shard is a
function of the data alone. Ranges of ids are cut until each fits a shard, and
a single id (or the rows without one) that doesn't is cut by digest. A task
writes a shard's records in order, each its own gzip member, and rolls to a
new file beyond a compressed size. Files are
written under a temporary name and renamed; the manifest that Spark commits
lists the files of the successful attempts, and readers trust it alone. A
repeated attempt writes the same bytes under the same name again.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from silkgraph.llm.common import materialize, shared_dir, table

#: Payloads of this many bytes or more are stored once.
MIN_REVISIT = 1000
#: Compressed bytes after which a file is closed, and that a task reads; payload bytes for a shard, and the most shards: beyond them shards grow, and roll.
ROLL_BYTES, READ_BYTES, SHARD_BYTES, MAX_SHARDS = 64 << 20, 64 << 20, 32 << 20, 1 << 16
#: Ranges of ids whose bytes are summed at once.
RANGES = 4096
#: The capture time isn't in the data; records carry this one.
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "_manifest"
MEMBER = "file string, records long, bytes long, sha1 string"


def record_id(page_id: int | None, digest: str) -> str:
    """A URN that depends on id and payload only."""
    raw = hashlib.sha1(f"{page_id}|{digest}".encode()).digest()[:16]
    return f"<urn:uuid:{uuid.UUID(bytes=raw, version=5)}>"


def base32(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


def one_line(text: str | None) -> str:
    return " ".join((text or "").split())


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, refers_url: str | None) -> bytes:
    """One WARC record; headers and digests are made anew from the payload."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    headers = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", record_id(page_id, digest)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", one_line(url)),
        ("WARC-Payload-Digest", f"sha1:{base32(digest)}"),
        ("WARC-Block-Digest", f"sha1:{base32(hashlib.sha1(block).hexdigest())}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if page_id is not None:
        headers.append(("X-Page-ID", str(page_id)))
    if revisit:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, digest)), ("WARC-Refers-To-Target-URI", one_line(refers_url)), ("X-Refers-To-Page-ID", str(refers_to))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def gzip_member(data: bytes) -> bytes:
    """A gzip member without time stamp or name: equal data give equal bytes."""
    z = zlib.compressobj(6, zlib.DEFLATED, -15)
    return b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\xff" + z.compress(data) + z.flush() + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def members(stream) -> Iterator[bytes]:
    """The gzip members of a stream, decompressed one by one."""
    z, got, left = zlib.decompressobj(31), [], b""
    while chunk := left or stream.read(1 << 20):
        got.append(z.decompress(chunk))
        left = b""
        if z.eof:
            left = z.unused_data
            yield b"".join(got)
            z, got = zlib.decompressobj(31), []
    if any(got):
        raise ValueError("an archive ends within a record")


def parse(data: bytes) -> dict:
    """Headers, and for responses the payload, of one record; digests are checked."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    h = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(h["Content-Length"])]
    if h["WARC-Block-Digest"] != f"sha1:{base32(hashlib.sha1(block).hexdigest())}":
        raise ValueError(f"damaged block in {h['WARC-Record-ID']}")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(http.decode().split("Content-Length: ")[1].split("\r\n")[0])
    digest = base64.b32decode(h["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    if h["WARC-Type"] == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"damaged payload in {h['WARC-Record-ID']}")
    return {
        "page_id": int(h["X-Page-ID"]) if "X-Page-ID" in h else None, "url": h["WARC-Target-URI"], "record_type": h["WARC-Type"], "payload_bytes": size, "payload_digest": digest,
        "refers_to": int(h["X-Refers-To-Page-ID"]) if "X-Refers-To-Page-ID" in h else None, "payload": payload if h["WARC-Type"] == "response" else None,
    }


def payload_of(html: str):
    return F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8")


def index(pages: DataFrame) -> DataFrame:
    """``page_id, url, digest, bytes`` per row of ``pages``: what layout and revisits need, without payloads."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload_of("html").alias("payload"))
    return rows.select("page_id", "url", F.sha1("payload").alias("digest"), F.octet_length("payload").cast("long").alias("bytes"))


def revisits(rows: DataFrame) -> DataFrame:
    """``page_id, digest, refers_to, refers_url`` of the records that another one stands for, from :func:`index`.

    Of equal payloads of ``MIN_REVISIT`` bytes or more the record with the
    largest id is the response; repeated rows of that id are responses too, and
    so are rows without id, which nothing refers to.
    """
    large = rows.where("page_id is not null").where(F.col("bytes") >= MIN_REVISIT)
    first = large.groupBy("digest").agg(F.max(F.struct("page_id", "url")).alias("top"), F.count("*").alias("n")).where("n > 1").select("digest", "top")
    found = large.select("page_id", "digest").join(first, "digest").where("page_id < top.page_id")
    return found.select("page_id", "digest", F.col("top.page_id").alias("refers_to"), F.col("top.url").alias("refers_url")).distinct()


class Layout:
    """Shards of rows by id and the head of their digest (32 bits).

    ``starts`` are the first ids of ranges, ascending; a range's rows go to
    ``parts`` shards from ``first`` on, by digest. Rows without id are the
    first range.
    """

    def __init__(self, rows: DataFrame, shard_bytes: int):
        size = F.col("bytes") + 512
        none = F.col("page_id").isNull()
        r = rows.agg(F.min("page_id").alias("low"), F.max("page_id").alias("high"), F.sum(size).alias("all"), F.sum(F.when(none, size)).alias("none")).first()
        self.limit = max(shard_bytes, -(-(r["all"] or 0) // MAX_SHARDS))
        ranges: list[tuple[int, int, int]] = []  # first id, id after the last, bytes
        heavy = [] if r["low"] is None else [(r["low"], r["high"] + 1)]
        while heavy:  # cut what doesn't fit a shard, all at once
            cuts = max(2, RANGES // len(heavy))
            edges = [min(lo + -(-(hi - lo) // cuts) * j, hi) for lo, hi in heavy for j in range(cuts)]
            starts, ends = np.array([min(x, (1 << 63) - 1) for x in edges], np.int64), [hi for lo, hi in heavy for _ in range(cuts)]
            low, high = np.array([lo for lo, _ in heavy], np.int64), np.array([hi - 1 for _, hi in heavy], np.int64)
            if len(heavy) == 1 and heavy[0][1] - heavy[0][0] < 1 << 62:  # no need for Python
                lo, hi = heavy[0]
                inside = (F.col("page_id") >= lo) & (F.col("page_id") < hi)
                cell = F.when(inside, F.expr(f"(page_id - {lo}L) div {-(-(hi - lo) // cuts)}L")).otherwise(F.lit(-1))
            else:
                cell = F.pandas_udf(_cells(low, high, starts), "long")("page_id")
            sums = rows.where("page_id is not null").groupBy(cell.alias("c")).agg(F.sum(size).alias("n")).where("c >= 0").collect()
            heavy = []
            for c, n in sorted((x["c"], x["n"]) for x in sums):
                lo, hi = int(starts[c]), ends[c] if (c + 1) % cuts == 0 else int(starts[c + 1])
                if n > self.limit and hi - lo > 1:
                    heavy.append((lo, hi))
                else:
                    ranges.append((lo, hi, n))
        shard, held, started = 0, 0, False
        self.none_parts = -(-r["none"] // self.limit) if r["none"] else 0
        shard = self.none_parts
        starts, first, parts = [], [], []
        for lo, _, n in sorted(ranges):
            if started and held + n > self.limit:
                shard, held = shard + last, 0
            starts.append(lo)
            first.append(shard)
            last = max(1, -(-n // self.limit))
            parts.append(last)
            held, started = held + n, True
        self.starts, self.first, self.parts = (np.array(x, np.int64) for x in (starts, first, parts))
        self.shards = max(1, shard + (parts[-1] if parts else 0))

    def column(self, page_id: str, digest: str):
        """The shard of a row."""
        starts, first, parts, none_parts = self.starts, self.first, self.parts, self.none_parts

        def run(ids: pd.Series, missing: pd.Series, head: pd.Series) -> pd.Series:
            if not len(starts):
                return (head * none_parts) >> 32
            at = np.maximum(0, np.searchsorted(starts, ids.to_numpy(), side="right") - 1)
            own = first[at] + ((head.to_numpy() * parts[at]) >> 32)
            return pd.Series(np.where(missing.to_numpy(bool), (head.to_numpy() * none_parts) >> 32, own))

        head = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
        return F.pandas_udf(run, "long")(F.coalesce(F.col(page_id).cast("long"), F.lit(0).cast("long")), F.col(page_id).isNull(), head).cast("int")


def _cells(low: np.ndarray, high: np.ndarray, starts: np.ndarray):
    """Number of the cut of a heavy range that an id is in, or -1."""

    def run(ids: pd.Series) -> pd.Series:
        x = ids.to_numpy()
        at = np.maximum(0, np.searchsorted(low, x, side="right") - 1)
        return pd.Series(np.where((x >= low[at]) & (x <= high[at]), np.searchsorted(starts, x, side="right") - 1, -1))

    return run


def write_warc(pages: DataFrame, path: str, shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Write ``pages`` (``page_id, url, html``) as WARC files below ``path``.

    Returns the manifest: ``file, records, bytes, sha1``. Null html is an
    empty payload, a null url an empty one; rows without id come first. An
    empty table gives an empty manifest and no files. ``path`` must be in a
    folder shared by all executors; extra columns aren't stored.
    """
    spark = pages.sparkSession
    narrow = materialize(index(pages), "index")
    layout = Layout(narrow, shard_bytes)
    payload = payload_of("html")
    records = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload")).select("*", F.sha1("payload").alias("digest"), F.lit(None).cast("long").alias("refers_to"), F.lit(1).alias("kind"))
    # a revisit's link comes right before the record it is for: payloads are shuffled once
    links = revisits(narrow).select("page_id", F.col("refers_url").alias("url"), F.lit(None).cast("binary").alias("payload"), "digest", "refers_to", F.lit(0).alias("kind"))
    rows = records.unionByName(links).withColumn("shard", layout.column("page_id", "digest"))
    placed = rows.repartitionByRange(layout.shards, "shard").sortWithinPartitions("shard", F.asc_nulls_first("page_id"), "kind", "digest", "url")
    target = path.rstrip("/")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = fs.FileSystem.from_uri(target)
        store.create_dir(root, recursive=True)
        out, state = [], {"shard": None, "file": None}

        def close() -> None:
            if state["file"] is not None:
                state["file"].close()
                store.move(f"{root}/{state['tmp']}", f"{root}/{state['name']}")
                out.append((state["name"], state["records"], state["bytes"], state["sha1"].hexdigest()))
                state["file"] = None

        def start(shard: int, seq: int) -> None:
            close()
            name = f"part-{shard:06d}-{seq:04d}.warc.gz"
            tmp = f"_tmp-{uuid.uuid4().hex}-{name}"
            state.update(shard=shard, seq=seq, name=name, tmp=tmp, file=store.open_output_stream(f"{root}/{tmp}", compression=None), records=0, bytes=0, sha1=hashlib.sha1())

        number = lambda x: None if x is pd.NA else int(x)
        linked: tuple = (None, {})
        for pdf in batches:
            cols = (pdf["page_id"].astype("Int64"), pdf["url"], pdf["payload"], pdf["digest"], pdf["refers_to"].astype("Int64"), pdf["kind"], pdf["shard"])
            for page_id, url, payload, digest, refers, kind, shard_no in zip(*cols, strict=True):
                page_id, url = number(page_id), url if isinstance(url, str) else None
                if kind == 0:
                    if linked[0] != page_id:
                        linked = (page_id, {})
                    linked[1][digest] = (int(refers), url)
                    continue
                if state["shard"] != shard_no:
                    start(int(shard_no), 0)
                elif state["bytes"] >= roll_bytes:
                    start(int(shard_no), state["seq"] + 1)
                ref, ref_url = linked[1].get(digest, (None, None)) if page_id is not None and linked[0] == page_id else (None, None)
                data = gzip_member(record(page_id, url, bytes(payload), digest, ref, ref_url))
                state["file"].write(data)
                state["sha1"].update(data)
                state["records"] += 1
                state["bytes"] += len(data)
        close()
        yield pd.DataFrame(out, columns=["file", "records", "bytes", "sha1"])

    placed.select("page_id", "url", "payload", "digest", "refers_to", "kind", "shard").mapInPandas(write, MEMBER).write.parquet(f"{target}/{MANIFEST}")
    return spark.read.schema(MEMBER).parquet(f"{target}/{MANIFEST}")


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records of all files in the manifest of ``path``; any damage is an error. Without ``payloads`` those are checked but not returned.

    A task reads about ``READ_BYTES``, or a file.
    """
    target = path.rstrip("/")
    listed = spark.read.schema(MEMBER).parquet(f"{target}/{MANIFEST}")
    files, size = listed.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    tasks = min(files, max(-(-size // READ_BYTES), spark.sparkContext.defaultParallelism))
    dealt = listed.repartition(max(1, tasks))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = fs.FileSystem.from_uri(target)
        names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"]
        frame = lambda rows: pd.DataFrame(rows, columns=names).astype({"page_id": "Int64", "refers_to": "Int64"})
        for pdf in batches:
            for name, records in zip(pdf["file"], pdf["records"], strict=True):
                rows, n, held = [], 0, 0
                with store.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for data in members(stream):
                        rows.append(parse(data) if payloads else parse(data) | {"payload": None})
                        n, held = n + 1, held + len(data)
                        if held > 8 << 20:
                            yield frame(rows)
                            rows, held = [], 0
                if n != records:
                    raise ValueError(f"{name} has {n} records, the manifest says {records}")
                yield frame(rows)

    return dealt.select("file", "records").mapInPandas(read, "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all pages, read the archives back and return what they say."""
    path = shared_dir(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), path)
    return read_warc(spark, path, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
with p as (select page_id, encode(coalesce(html, '')) b from pages),
d as (select page_id, octet_length(b) n, sha1(b) h from p),
m as (select h, max(page_id) top from d where n >= 1000 group by h)
select d.page_id, cast(d.n as bigint) payload_bytes, d.h payload_digest, case when m.top > d.page_id then 'revisit' else 'response' end record_type,
  case when m.top > d.page_id then m.top end refers_to
from d left join m on m.h = d.h and d.n >= 1000
"""
