"""WARC archives: a sink and a splittable source, as Spark data sources, and the dedup of page captures.

Sink: each task writes gzip members, one per record, into files of its own and rolls over at a size.
The driver's commit lists the files of the tasks that succeeded in a manifest; files of lost or repeated
attempts are in no manifest and are never read.

Source: tasks scan byte ranges.  A task looks for the gzip magic from its range's start on, decodes the
beginning of every candidate and takes it for a record only if it decodes to a WARC version line; it owns
all records that *start* inside its range and reads the last one beyond the range's end.  Behind a record
the next one is expected at once, so the search costs only what precedes a range's first record.  Memory:
one block, one record and one batch.  A record that is cut off or damaged comes with ``problem`` set and
the search goes on behind its magic.  (A payload that is itself an uncompressible archive may be stored
verbatim by other writers; a range that starts inside it would see its members.)

``write_pages`` writes one record per page: of pages with equal payloads of at least ``least_bytes``, the
one with the smallest id is a response, the others are revisits without payload that refer to it; smaller
payloads are all responses.  Which id is smallest is found from digests, salted by id; pages meet that
table in a join keyed by digest and salt, so a payload that many pages share is spread over many tasks.

Defined cases: a null html is an empty payload, a null url is left out, control characters in a url are
percent-encoded; pages without id are responses, and so are rows that repeat the smallest id; an empty
table gives an archive without records; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    InputPartition,
    WriterCommitMessage,
)

from llm.common import Scratch, small_batches
from llm.first_copies import first_copies, salt_of

MAGIC = b"\x1f\x8b\x08"
MANIFEST = "_manifest.json"
SUFFIX = ".warc.gz"
#: A range of an archive that one task scans.
SPLIT_BYTES = 64 << 20
#: A task starts another file behind this size.
FILE_BYTES = 1 << 30
#: Bytes read at a time, fed to the inflater at a time, and held in a batch of rows.
BLOCK, PIECE, BATCH_BYTES = 1 << 20, 16 << 10, 16 << 20
#: All records carry one date, so that reruns agree.
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORDS = ("record_id string, record_type string, url string, date string, refers_to string, payload_digest string, "
           "payload_bytes long, payload binary, problem string, file string, offset long")
ARROW = {"payload_bytes": pa.int64(), "payload": pa.binary(), "offset": pa.int64()}


# -- one record ----------------------------------------------------------------------
def record_bytes(row: dict) -> bytes:
    """A WARC/1.1 record as one gzip member."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n".encode()
    block = http + (row["payload"] or b"")
    head = [("WARC-Type", row["record_type"]), ("WARC-Record-ID", f"<{row['record_id']}>"), ("WARC-Date", row["date"])]
    if row["url"] is not None:
        head.append(("WARC-Target-URI", re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", row["url"])))
    if row["refers_to"] is not None:
        head += [("WARC-Refers-To", f"<{row['refers_to']}>"), ("WARC-Profile", PROFILE)]
    head += [("WARC-Payload-Digest", f"sha256:{row['payload_digest']}"),
             ("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n"
    packer = zlib.compressobj(wbits=31)
    return packer.compress(text.encode()) + packer.compress(block) + packer.compress(b"\r\n\r\n") + packer.flush()


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}


def parsed(data: bytes) -> dict:
    """The row of one decoded member."""
    head, _, rest = data.partition(b"\r\n\r\n")
    f = _fields(head)
    length = int(f["content-length"]) if f.get("content-length", "").isdigit() else -1
    problem = None if 0 <= length == len(rest) - 4 and rest.endswith(b"\r\n\r\n") else "length"
    http, _, payload = rest[:max(length, 0)].partition(b"\r\n\r\n")
    digest = f.get("warc-payload-digest", "").removeprefix("sha256:") or None
    kind = f.get("warc-type")
    if kind == "revisit":
        told = _fields(http).get("content-length", "")
        size, payload = (int(told) if told.isdigit() else None), None
    else:
        size, found = len(payload), hashlib.sha256(payload).hexdigest()
        if digest is not None and digest != found:
            problem = problem or "digest"
        digest = found
    strip = {k: f[k][1:-1] if f.get(k, "").startswith("<") else f.get(k) for k in ("warc-record-id", "warc-refers-to")}
    return {"record_id": strip["warc-record-id"], "record_type": kind, "url": f.get("warc-target-uri"),
            "date": f.get("warc-date"), "refers_to": strip["warc-refers-to"], "payload_digest": digest,
            "payload_bytes": size, "payload": payload, "problem": problem}


# -- byte ranges -----------------------------------------------------------------------
class Blocks:
    """Forward reading through one cached block."""

    def __init__(self, handle: pa.NativeFile):
        self.handle, self.base, self.block = handle, 0, b""

    def load(self, offset: int, least: int = 1) -> None:
        """Have ``least`` bytes from ``offset`` on in the block, if the file has them."""
        if not self.base <= offset <= self.base + len(self.block) - least:
            self.base, self.block = offset, self.handle.read_at(BLOCK, offset)

    def piece(self, offset: int) -> bytes:
        """Some bytes from ``offset`` on; none at the file's end."""
        self.load(offset)
        return self.block[offset - self.base:offset - self.base + PIECE]

    def magic(self, offset: int, end: int) -> int | None:
        """Where the next gzip magic begins, from ``offset`` and before ``end``."""
        while offset < end:
            self.load(offset, len(MAGIC))
            if offset + len(MAGIC) > self.base + len(self.block):
                return None
            found = self.block.find(MAGIC, offset - self.base)
            if found >= 0:
                return self.base + found if self.base + found < end else None
            offset = self.base + len(self.block) - len(MAGIC) + 1
        return None


def member(blocks: Blocks, start: int) -> tuple[dict | None, int]:
    """The record that begins at ``start`` and the offset behind it; no record: (None, start + 1)."""
    inflate, known, at, begun = zlib.decompressobj(31), False, start, b""
    try:
        # No more than tells whether this is a record; a block may end anywhere in its first bytes.
        while len(begun) < 7 and not inflate.eof and (piece := blocks.piece(at)):
            begun += inflate.decompress(piece, 64)
            at += len(piece)
        known = begun.startswith(b"WARC/1.")
        if not known:
            return None, start + 1
        out = [begun, inflate.decompress(inflate.unconsumed_tail)]
        while not inflate.eof and (piece := blocks.piece(at)):
            out.append(inflate.decompress(piece))
            at += len(piece)
    except zlib.error:
        return ({"problem": "damaged"} if known else None), start + 1
    if not inflate.eof:
        return {"problem": "cut off"}, start + 1
    return parsed(b"".join(out)), at - len(inflate.unused_data)


def records(handle: pa.NativeFile, start: int, end: int) -> Iterator[dict]:
    """The records that start in [start, end)."""
    blocks, at = Blocks(handle), start
    while (found := blocks.magic(at, end)) is not None:
        row, at = member(blocks, found)
        if row is not None:
            yield {**row, "offset": found}


# -- data source --------------------------------------------------------------------------
def place(path: str) -> tuple[fs.FileSystem, str]:
    if re.match(r"file:/[^/]", path):
        path = "file://" + path[5:]
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


@dataclass
class Range(InputPartition):
    file: str
    start: int
    end: int


@dataclass
class Written(WriterCommitMessage):
    files: list


class WarcReader(DataSourceReader):
    def __init__(self, path: str, names: list[str], split: int):
        self.path, self.names, self.split = path.rstrip("/"), names, split

    def partitions(self) -> list[Range]:
        store, root = place(self.path)
        if store.get_file_info(root).type == fs.FileType.File:
            infos = [store.get_file_info(root)]
        elif store.get_file_info(f"{root}/{MANIFEST}").type == fs.FileType.File:
            with store.open_input_stream(f"{root}/{MANIFEST}") as f:
                names = json.loads(f.read())
            infos = store.get_file_info([f"{root}/{n}" for n in names]) if names else []
        else:
            infos = [i for i in store.get_file_info(fs.FileSelector(root)) if i.path.endswith(SUFFIX)]
        cuts = [(i.path, a, min(a + self.split, i.size)) for i in sorted(infos, key=lambda i: i.path)
                for a in range(0, i.size, self.split)]
        return [Range(*c) for c in cuts]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not isinstance(partition, Range):  # an archive without files
            return
        store, _ = place(self.path)
        name = partition.file.rsplit("/", 1)[-1]
        with store.open_input_file(partition.file) as handle:
            rows, held = [], 0
            for row in records(handle, partition.start, partition.end):
                rows.append({**row, "file": name})
                held += len(row.get("payload") or b"") if "payload" in self.names else 200
                if held >= BATCH_BYTES or len(rows) >= 1000:
                    yield self._batch(rows)
                    rows, held = [], 0
            if rows:
                yield self._batch(rows)

    def _batch(self, rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([r.get(n) for r in rows], ARROW.get(n, pa.string())) for n in self.names], names=self.names)


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str, file_bytes: int):
        self.path, self.file_bytes = path.rstrip("/"), file_bytes

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = place(self.path)
        store.create_dir(root, recursive=True)
        mine = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}"
        names, out, size = [], None, 0
        try:
            for batch in iterator:
                for row in batch.to_pylist():
                    if out is None or size >= self.file_bytes:
                        if out is not None:
                            out.close()
                        names.append(f"{mine}-{len(names):04d}{SUFFIX}")
                        out, size = store.open_output_stream(f"{root}/{names[-1]}", compression=None), 0
                    data = record_bytes(row)
                    out.write(data)
                    size += len(data)
        finally:
            if out is not None:
                out.close()
        return Written(names)

    def commit(self, messages: list) -> None:
        store, root = place(self.path)
        store.create_dir(root, recursive=True)
        files = sorted(n for m in messages if m is not None for n in m.files)
        with store.open_output_stream(f"{root}/{MANIFEST}", compression=None) as f:
            f.write(json.dumps(files).encode())

    def abort(self, messages: list) -> None:
        store, root = place(self.path)
        for name in (n for m in messages if m is not None for n in m.files):
            store.delete_file(f"{root}/{name}")


class WarcSource(DataSource):
    """``spark.read.format("warc")`` and ``df.write.format("warc")``; a schema that leaves ``payload`` out skips it."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return RECORDS

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options["path"], schema.names, int(self.options.get("split_bytes", SPLIT_BYTES)))

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        if overwrite:
            raise ValueError("archives are never overwritten: name a new folder")
        return WarcWriter(self.options["path"], int(self.options.get("file_bytes", FILE_BYTES)))


# -- pages in, pages out ------------------------------------------------------------------
def qualified(spark: SparkSession, path: str) -> str:
    """The path with its scheme, as Spark resolves it, for tasks that open it themselves."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString()


def page_records(scratch: Scratch, pages: DataFrame, id_col: str, url_col: str, html_col: str, least_bytes: int) -> DataFrame:
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    plain = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    sized = plain.select("id", "url", payload.alias("payload"), F.sha2(payload, 256).alias("digest"),
                         F.octet_length(payload).cast("long").alias("payload_bytes"))
    slim = sized.where(F.col("payload_bytes") >= least_bytes).select("id", F.unhex("digest").alias("digest"))
    firsts = first_copies(scratch, slim, "digest", "id")
    same = ((F.unhex("digest") == F.col("key")) & (salt_of("id") == F.col("salt")) & (F.col("payload_bytes") >= least_bytes))
    again = F.coalesce(F.col("id") > F.col("first"), F.lit(False))

    def urn(column):
        return F.concat(F.lit("urn:page:"), F.coalesce(F.url_encode(F.col(column).cast("string")), F.lit("")),
                        F.lit(":"), F.substring("digest", 1, 16))

    return sized.join(firsts, same, "left").select(
        urn("id").alias("record_id"), F.when(again, "revisit").otherwise("response").alias("record_type"), "url",
        F.lit(DATE).alias("date"), F.when(again, urn("first")).alias("refers_to"), F.col("digest").alias("payload_digest"),
        "payload_bytes", F.when(~again, F.col("payload")).alias("payload"))


def write_pages(pages: DataFrame, path: str, *, least_bytes: int = 100, file_bytes: int = FILE_BYTES,
                id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """One WARC record per page below the folder ``path``, which must be new."""
    spark = pages.sparkSession
    small_batches(spark)
    spark.dataSource.register(WarcSource)
    with Scratch(spark) as scratch:
        rows = page_records(scratch, pages, id_col, url_col, html_col, least_bytes)
        rows.write.format("warc").mode("append").option("file_bytes", str(file_bytes)).save(qualified(spark, path))


def read_records(spark: SparkSession, path: str, *, split_bytes: int = SPLIT_BYTES, payload: bool = True) -> DataFrame:
    """A row per record of the archives below ``path``, or of the one file ``path``."""
    spark.dataSource.register(WarcSource)
    schema = RECORDS if payload else RECORDS.replace("payload binary, ", "")
    return spark.read.format("warc").schema(schema).option("split_bytes", str(split_bytes)).load(qualified(spark, path))


def page_digests(records_: DataFrame, id_type: str = "bigint") -> DataFrame:
    """Page ids and kinds of records that ``write_pages`` wrote."""
    def page(column):
        coded = F.split_part(F.col(column), F.lit(":"), F.lit(3))
        return F.when(coded != "", F.url_decode(coded)).cast(id_type)

    return records_.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                           page("refers_to").alias("refers_to"), "problem")


def archived(pages: DataFrame, *, least_bytes: int = 100, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Writes the pages into archives in the shared folder, reads them back, and lists what was read."""
    spark = pages.sparkSession
    with Scratch(spark) as scratch:
        path = f"{scratch.folder}/inner/warc"
        write_pages(pages, path, least_bytes=least_bytes)
        id_type = pages.schema["page_id"].dataType.simpleString()
        return scratch.result(page_digests(read_records(spark, path, split_bytes=split_bytes, payload=False), id_type))
