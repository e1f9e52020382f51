"""WARC archives: a deterministic sharded writer and a reader.

Writer: records are dealt by ranges of their id into shards of a bounded size
and sorted in them; a range that is too large is divided further, one id by
its digests. A task writes a shard, one gzip member a record, and rolls to a
new file by compressed size. Headers and
digests are made anew; of equal long payloads one record is a response and the
others revisit it. Files get temporary names that no other attempt shares; the
attempt that counts is the one whose rows are in the manifest, and only its
files are renamed. A lost executor costs a retry, never a torn or double file.

The folder is reached through ``pyarrow.fs`` by its URI, so it can be a shared
mount or an object store.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from decimal import Decimal
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.llm import words
from lakeloom.session import cut, n_partitions, remove

_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # RFC 4122, names that are URLs
_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
#: Ranges of ids whose sizes are counted first to place the shards.
_BINS = 1 << 14
_MANIFEST = "shard int, number int, name string, temporary string, records long, bytes long, sha1 string"


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:/") and not uri.startswith("file:///"):
        uri = "file://" + uri[5:]
    return (fs.LocalFileSystem(), uri) if uri.startswith("/") else fs.FileSystem.from_uri(uri)


def record_id(page: int | None, digest: str) -> str:
    """The same record always has the same id."""
    return f"urn:uuid:{uuid.uuid5(_SPACE, f'{page}/{digest}')}"


def record(page: int | None, url: str | None, payload: bytes, first: int | None, date: str) -> bytes:
    """One record; ``first``: the page whose record it revisits."""
    sha = hashlib.sha1(payload)
    head = {
        "WARC-Type": "response" if first is None else "revisit",
        "WARC-Record-ID": f"<{record_id(page, sha.hexdigest())}>",
        "WARC-Date": date,
        "WARC-Payload-Digest": "sha1:" + base64.b32encode(sha.digest()).decode(),
        "Content-Type": "application/http;msgtype=response",
        "X-Payload-Length": len(payload),
    }
    if url is not None:
        head["WARC-Target-URI"] = quote(url, safe="".join(map(chr, range(0x21, 0x7F))))
    if page is not None:
        head["X-Page-Id"] = page
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if first is None:
        block = http + b"Content-Length: %d\r\n\r\n" % len(payload) + payload
    else:
        head |= {"WARC-Profile": _PROFILE, "WARC-Refers-To": f"<{record_id(first, sha.hexdigest())}>", "X-Refers-To-Page": first}
        block = http + b"\r\n"
    head |= {"WARC-Block-Digest": "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode(), "Content-Length": len(block)}
    return b"WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    names = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(names["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a torn WARC record")
    return names, block


def members(stream, size: int = 1 << 20) -> Iterator[bytes]:
    """The gzip members of a stream, one at a time."""
    unzip, held, parts = zlib.decompressobj(31), b"", []
    while True:
        data = held or stream.read(size)
        held = b""
        if not data:
            break
        parts.append(unzip.decompress(data))
        if unzip.eof:
            held = unzip.unused_data
            yield b"".join(parts)
            unzip, parts = zlib.decompressobj(31), []
    if any(parts):
        raise ValueError("a torn gzip member")


class _Writer:
    """The files of one attempt."""

    def __init__(self, folder: str, roll: int) -> None:
        self.files, self.root = _open(folder)
        self.roll, self.attempt = roll, uuid.uuid4().hex
        self.shard = self.number = -1
        self.stream = None
        self.made: list[tuple] = []

    def write(self, shard: int, data: bytes) -> None:
        if shard != self.shard:
            self.close()
            self.shard, self.number = shard, -1
        elif self.stream is not None and self.bytes >= self.roll:
            self.close()
        if self.stream is None:
            self.number += 1
            self.temporary = f"_temporary/{self.shard:06d}-{self.number:04d}.{self.attempt}"
            self.files.create_dir(f"{self.root}/_temporary", recursive=True)
            self.stream = self.files.open_output_stream(f"{self.root}/{self.temporary}", compression=None)
            self.records, self.bytes, self.sha = 0, 0, hashlib.sha1()
        zipper = zlib.compressobj(6, zlib.DEFLATED, 31)
        member = zipper.compress(data) + zipper.flush()
        self.stream.write(member)
        self.sha.update(member)
        self.records, self.bytes = self.records + 1, self.bytes + len(member)

    def close(self) -> None:
        if self.stream is not None:
            self.stream.close()
            self.stream = None
            self.made.append((self.shard, self.number, f"shard-{self.shard:06d}-{self.number:04d}.warc.gz", self.temporary, self.records, self.bytes, self.sha.hexdigest()))


def _batch(rows: list[tuple], names: list[str], kinds: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(kinds), kinds)], names=names)


#: Shards at most; beyond that they hold more bytes each.
SHARDS = 1 << 16


def _bin(value, low, width):
    """Number of a value's range from 0; decimal, so that ids may span all 64 bits."""
    return F.floor((value.cast("decimal(20,0)") - low) / width).cast("int")


def _place(small: DataFrame, shard_bytes: int) -> tuple[list[DataFrame], int]:
    """Ranges of (page, digest) of about ``shard_bytes``, as steps of a search; the number of shards.

    small: page, mark (the digest's first 32 bits), size. A step has the ranges
    (node, bin) with their shard, or for a range of over a shard's bytes the
    node that divides it further: by page, and where a range is one page by
    mark. Ranges depend on the rows alone. The driver sees a row for each range
    of the first step and at most 16 for each shard's worth of bytes after it.
    """
    spark = small.sparkSession
    whole = small.agg(F.sum("size"), F.min("page"), F.max("page")).first()
    shard_bytes = max(shard_bytes, -(-(whole[0] or 0) // SHARDS))
    # node: (by mark, low, width); path: its place in the order of all ranges
    low, high = (0, 0) if whole[1] is None else whole[1:]
    nodes = [(0, 0, low, -(-(high - low + 1) // _BINS), ())]
    leaves, steps, count = [], [], 1
    while nodes:
        table = spark.createDataFrame([(n, m, Decimal(lo), Decimal(w)) for n, m, lo, w, _ in nodes], "node int, by_mark int, low decimal(20,0), width decimal(20,0)")
        paths = {n: (m, path) for n, m, _, _, path in nodes}
        small = small.withColumn("node", F.lit(0)) if not steps else small
        small = small.join(F.broadcast(table), "node")
        value = F.when(F.col("by_mark") == 1, F.col("mark")).otherwise(F.col("page"))
        small = small.withColumn("bin", F.coalesce(_bin(value, F.col("low"), F.col("width")), F.lit(-1)))
        found = small.groupBy("node", "bin").agg(F.sum("size").alias("size"), F.min("page").alias("a"), F.max("page").alias("b"), F.min("mark").alias("c"), F.max("mark").alias("d")).collect()
        nodes, deeper = [], []
        for r in found:
            by_mark, path = paths[r.node]
            path = (*path, r.bin)
            one_page = by_mark or r.a == r.b
            if r["size"] > shard_bytes and (r.c != r.d if one_page else True):
                lo, hi = (r.c, r.d) if one_page else (r.a, r.b)
                nodes.append((count, int(bool(one_page)), lo, -(-(hi - lo + 1) // 16), path))
                deeper.append((r.node, r.bin, count))
                count += 1
            else:
                leaves.append((path, len(steps), r.node, r.bin, r["size"]))
        steps.append((table, deeper))
        if nodes:
            down = spark.createDataFrame(deeper, "node int, bin int, child int")
            small = cut(small.join(F.broadcast(down), ["node", "bin"]).select(F.col("child").alias("node"), "page", "mark", "size"))
    shard, held, shards = 0, 0, {}
    for path, step, node, number, size in sorted(leaves):
        if held and held + size > shard_bytes:
            shard, held = shard + 1, 0
        shards[step, node, number] = shard
        held += max(1, size)
    out = []
    for i, (table, deeper) in enumerate(steps):
        rows = [(n, b, s, None) for (step, n, b), s in shards.items() if step == i] + [(n, b, None, c) for n, b, c in deeper]
        out.append(table.join(spark.createDataFrame(rows, "node int, bin int, shard int, child int"), "node"))
    return out, shard + bool(held)


def _dealt(rows: DataFrame, steps: list[DataFrame]) -> DataFrame:
    """rows (page, mark, ..) with their shard: a bounded broadcast for each step of the search."""
    names = rows.columns
    rows = rows.withColumns({"_node": F.lit(0), "_shard": F.lit(None).cast("int")})
    for step in steps:
        nodes = step.select(F.col("node").alias("_node"), "by_mark", "low", "width").distinct()
        value = F.when(F.col("by_mark") == 1, F.col("mark")).otherwise(F.col("page"))
        number = F.when(F.col("by_mark").isNotNull(), F.coalesce(_bin(value, F.col("low"), F.col("width")), F.lit(-1)))
        rows = rows.join(F.broadcast(nodes), "_node", "left").withColumn("_bin", number).drop("by_mark", "low", "width")
        ends = step.select(F.col("node").alias("_node"), F.col("bin").alias("_bin"), F.col("shard").alias("_here"), "child")
        rows = rows.join(F.broadcast(ends), ["_node", "_bin"], "left").select(*names, F.col("child").alias("_node"), F.coalesce("_shard", "_here").alias("_shard"))
    return rows.select(*names, F.col("_shard").alias("shard"))


def write_archives(df: DataFrame, folder: str, shard_bytes: int = 32 << 20, roll_bytes: int = 8 << 20, revisit_from: int = 1000, date: str = "1970-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> str:
    """Write a record per row to ``folder`` (a URI that all executors share); the manifest's place.

    Files and their bytes depend on the rows alone, not on how they are
    partitioned. Defined cases: a null body is an empty payload; a null id
    sorts first, and its record has no page id; a null url leaves out the
    header; rows repeated in full are records each, all of one kind; an empty
    table gives a manifest without files; other columns are not looked at.
    """
    spark = df.sparkSession
    body = F.coalesce(F.col(body_col).cast("binary"), F.lit(b""))
    rows = df.select(F.col(id_col).cast("long").alias("page"), F.col(url_col).cast("string").alias("url"), body.alias("body"))
    rows = rows.withColumns({"digest": F.sha1("body"), "size": F.octet_length("body").cast("long") + 200})
    rows = rows.withColumn("mark", F.conv(F.substring("digest", 1, 8), 16, 10).cast("long"))
    small = rows.select("page", "digest", "mark", "size")
    steps, n_shards = _place(small.select("page", "mark", "size"), shard_bytes)

    groups = small.where(F.col("size") >= revisit_from + 200).groupBy("digest").agg(F.max("page").alias("first_page"), F.count(F.lit(1)).alias("copies")).where(F.col("copies") > 1).drop("copies")
    revisits = small.join(groups, "digest").where(F.col("first_page").isNotNull() & ~F.col("page").eqNullSafe(F.col("first_page"))).select("page", "mark", "digest", "first_page").distinct()
    none = F.lit(None)
    marks = revisits.select("page", "mark", "digest", F.lit(0).alias("kind"), none.cast("string").alias("url"), none.cast("binary").alias("body"), "first_page")
    records = rows.select("page", "mark", "digest", F.lit(1).alias("kind"), "url", "body", none.cast("long").alias("first_page"))
    # a task for each shard: none is split, none meets another by chance
    stream = _dealt(marks.unionByName(records), steps).repartitionById(max(1, n_shards), F.col("shard")).sortWithinPartitions("shard", "page", "digest", "kind", "url")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, key, first = _Writer(folder, roll_bytes), None, None
        for b in batches:
            for part in words.slices(b, "body"):
                for shard, page, digest, kind, url, body, at in zip(*(part.column(c).to_pylist() for c in ("shard", "page", "digest", "kind", "url", "body", "first_page"))):
                    if (page, digest) != key:
                        key, first = (page, digest), None
                    if kind == 0:
                        first = at
                    else:
                        own.write(shard, record(page, url, body, first, date))
        own.close()
        yield _batch(own.made, ["shard", "number", "name", "temporary", "records", "bytes", "sha1"], [pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()])

    manifest = f"{folder.rstrip('/')}/manifest"
    stream.mapInArrow(words.tidy(write), _MANIFEST).write.mode("overwrite").parquet(manifest)

    commit_files(spark, folder)
    return manifest


def commit_files(spark: SparkSession, folder: str) -> None:
    """Give the files of the manifest their names; it can be done again at any time."""
    folder = folder.rstrip("/")

    def commit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _open(folder)
        for b in batches:
            for name, temporary in zip(b.column("name").to_pylist(), b.column("temporary").to_pylist()):
                # a retry finds the file in place already
                if files.get_file_info(f"{root}/{temporary}").type != fs.FileType.NotFound:
                    files.move(f"{root}/{temporary}", f"{root}/{name}")
                elif files.get_file_info(f"{root}/{name}").type == fs.FileType.NotFound:
                    raise FileNotFoundError(name)
            yield b.select(["name"])

    spark.read.parquet(f"{folder}/manifest").select("name", "temporary").mapInArrow(commit, "name string").write.mode("overwrite").parquet(f"{folder}/committed")
    remove(spark, f"{folder}/_temporary")  # what lost attempts left


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """The records of the files that the manifest names: page_id, url, record_type, refers_to, payload_bytes, payload_digest, record_id, payload.

    The payload's size and digest are measured on the bytes of a response, and
    compared with its header; a revisit holds none, so they come from its
    header. A torn or altered record fails.
    """
    names = spark.read.parquet(f"{folder.rstrip('/')}/committed").repartition(n_partitions(spark), "name")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _open(folder)
        out: list[tuple] = []
        held = 0
        columns = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "record_id", "payload"]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
        for b in batches:
            for name in b.column("name").to_pylist():
                with files.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for data in members(stream):
                        head, block = parse(data)
                        digest = base64.b32decode(head["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                        number = lambda k: int(head[k]) if k in head else None
                        size, payload = number("X-Payload-Length"), None
                        if head["WARC-Type"] == "response":
                            payload = block.partition(b"\r\n\r\n")[2]
                            size = len(payload)
                            if hashlib.sha1(payload).hexdigest() != digest:
                                raise ValueError(f"{name}: a payload differs from its digest")
                        out.append((number("X-Page-Id"), head.get("WARC-Target-URI"), head["WARC-Type"], number("X-Refers-To-Page"), size, digest, head["WARC-Record-ID"].strip("<>"), payload))
                        held += len(payload or b"") + 200
                        if held > 4 << 20:
                            yield _batch(out, columns, kinds)
                            out, held = [], 0
        yield _batch(out, columns, kinds)

    return names.mapInArrow(words.tidy(read), "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, record_id string, payload binary")
