"""WARC archives in Zstandard: a writer, and a reader that decodes one frame per record and validates what it reads.

An archive starts with a skippable frame that holds the dictionary; each record is a frame of its own. Archives are files
of the shared storage, written and read through whatever file system holds it."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import BROADCAST_ROWS, cut, join_classes, scratch, ship_code, sliced

#: The magic numbers of a skippable frame with a dictionary, and of a Zstandard frame.
DICTIONARY_FRAME, ZSTD_FRAME = 0x184D2A5D, 0xFD2FB528
VERSION, PROFILE = b"WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payloads under this size are never revisits.
LEAST_REVISIT = 100
#: The dictionary: its bytes, and how many payloads of how many bytes at most it is trained on.
DICTIONARY, SAMPLES, SAMPLE_BYTES = 16_384, 400, 65_536
#: An archive is closed when it has this many bytes.
ARCHIVE_BYTES, LEVEL, SLICE = 64 << 20, 3, 1 << 16
DATE = "2024-01-01T00:00:00Z"
#: The table of archives that are whole, in a folder that listings of data leave out.
MANIFEST = "_archives"


class WarcError(ValueError):
    """An archive or record that does not hold what its headers say."""


def train_dictionary(payloads: list[bytes]) -> bytes | None:
    """A dictionary of at most DICTIONARY bytes; None where there are too few payloads to train on."""
    try:
        return zstandard.train_dictionary(DICTIONARY, payloads).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return None


def record(page_id: int | None, uri: str | None, payload: bytes, kind: str, refers_to: int | None) -> bytes:
    """One record. A revisit has the response's HTTP header, with the full length, and no payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if kind == "response" else b"")
    uri = "".join(c for c in uri or "" if c >= " ")
    head = {
        "WARC-Type": kind, "WARC-Record-ID": f"<urn:page:{'' if page_id is None else page_id}>", "WARC-Date": DATE, "WARC-Target-URI": uri,
        "WARC-Payload-Digest": f"sha256:{hashlib.sha256(payload).hexdigest()}", "WARC-Block-Digest": f"sha256:{hashlib.sha256(block).hexdigest()}",
        "Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block)),
    }
    if kind == "revisit":
        head |= {"WARC-Profile": PROFILE, "WARC-Refers-To": f"<urn:page:{refers_to}>"}
    return b"\r\n".join([VERSION, *(f"{k}: {v}".encode() for k, v in head.items()), b"", block, b"", b""])


class ArchiveWriter:
    """Frames for one archive: the dictionary, then a frame per record."""

    def __init__(self, out, dictionary: bytes | None):
        self.out, self.size = out, 0
        made = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self.compress = zstandard.ZstdCompressor(level=LEVEL, dict_data=made, write_checksum=True, write_content_size=True).compress
        if dictionary:
            packed = zstandard.ZstdCompressor(level=19).compress(dictionary)
            self._put(struct.pack("<II", DICTIONARY_FRAME, len(packed)) + packed)

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def write(self, data: bytes) -> None:
        self._put(self.compress(data))


def read_archive(data: bytes) -> Iterator[dict]:
    """The records of an archive, validated: id, uri, kind, refers_to, payload_bytes, payload_digest, payload."""
    view, at, dictionary = memoryview(data), 0, None
    while at + 8 <= len(view) and 0x184D2A50 <= (magic := struct.unpack_from("<I", view, at)[0]) <= 0x184D2A5F:
        size = struct.unpack_from("<I", view, at + 4)[0]
        held = bytes(view[at + 8 : at + 8 + size])
        if len(held) < size:
            raise WarcError("a skippable frame is cut off")
        if magic == DICTIONARY_FRAME and at == 0:
            if held[:4] == struct.pack("<I", ZSTD_FRAME):
                held = zstandard.ZstdDecompressor().decompress(held, max_output_size=1 << 27)
            dictionary = zstandard.ZstdCompressionDict(held)
        at += 8 + size
    reader = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    while at < len(view):
        frame, parts = reader.decompressobj(), []
        while not frame.eof:
            if at >= len(view):
                raise WarcError("a frame is cut off")
            piece = view[at : at + SLICE]
            try:
                parts.append(frame.decompress(piece))
            except zstandard.ZstdError as e:
                raise WarcError(f"a frame can't be decoded: {e}") from None
            at += len(piece)
        at -= len(frame.unused_data)
        yield parse_record(b"".join(parts))


def parse_record(data: bytes) -> dict:
    """A record's fields. Version, header lines, lengths, digests and the end of the record are checked."""
    head, found, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not found or lines[0] != VERSION:
        raise WarcError("no WARC header")
    fields: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.decode().partition(":")
        if not colon or not name or name != name.strip() or name.lower() in fields:
            raise WarcError(f"bad header line {line[:80]!r}")
        fields[name.lower()] = value.strip()
    if missing := {"warc-type", "warc-record-id", "warc-date", "content-length"} - fields.keys():
        raise WarcError(f"no {sorted(missing)[0]}")
    if not fields["content-length"].isdigit() or len(rest) != (size := int(fields["content-length"])) + 4 or rest[size:] != b"\r\n\r\n":
        raise WarcError("the block is not as long as Content-Length says")
    block = rest[:size]
    if "sha256:" + hashlib.sha256(block).hexdigest() != fields.get("warc-block-digest"):
        raise WarcError("the block is not what its digest says")
    http, found, payload = block.partition(b"\r\n\r\n")
    lengths = [int(v) for k, _, v in (x.partition(b":") for x in http.split(b"\r\n")[1:]) if k.lower() == b"content-length" and v.strip().isdigit()]
    if not found or not http.startswith(b"HTTP/") or len(lengths) != 1:
        raise WarcError("no HTTP header with one length")
    digest, kind = fields.get("warc-payload-digest", ""), fields["warc-type"]
    if kind == "response" and (len(payload) != lengths[0] or digest != "sha256:" + hashlib.sha256(payload).hexdigest()):
        raise WarcError("the payload is not what its length and digest say")
    if kind == "revisit" and (payload or "warc-refers-to" not in fields) or kind not in ("response", "revisit"):
        raise WarcError(f"a {kind} record that can't be")
    page = lambda x: int(x) if (x := x.removeprefix("<urn:page:").removesuffix(">")) else None
    return {
        "page_id": page(fields["warc-record-id"]), "url": fields.get("warc-target-uri"), "record_type": kind, "payload_bytes": lengths[0], "payload_digest": digest.removeprefix("sha256:"),
        "refers_to": page(fields["warc-refers-to"]) if kind == "revisit" else None, "payload": payload if kind == "response" else None,
    }


def record_types(pages: DataFrame) -> DataFrame:
    """page_id, digest, refers_to (null for responses): of equal payloads of LEAST_REVISIT bytes or more, the smallest id is the response."""
    payload = F.coalesce("html", F.lit("")).cast("binary")
    rows = cut(pages.select("page_id", F.unhex(F.sha2(payload, 256)).alias("digest"), F.octet_length(payload).alias("n")))
    large = rows.where(F.col("n") >= LEAST_REVISIT)
    groups = cut(large.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("size")).where("size > 1"))
    return join_classes(large, groups, "digest", "size", rows.count(), "inner").where("page_id <> first").select("page_id", "digest", F.col("first").alias("refers_to"))


def _uri(path: str) -> str:
    if "://" in path:
        return path
    return "file://" + path.removeprefix("file:")


def write_archives(pages: DataFrame, path: str | None = None, archive_bytes: int = ARCHIVE_BYTES) -> str:
    """Writes a record per row of pages (page_id, url, html); returns the folder of the archives.

    Null html is an empty payload, a null url an empty one. Rows with a null id are responses with an empty id; rows that
    repeat an id and a payload are of one type. An empty table leaves a folder without archives. Every attempt of a task writes
    files of its own, and Spark commits the names of those that succeeded to the manifest: what a lost executor or a
    speculative attempt leaves behind is never read."""
    spark = pages.sparkSession
    path = path or scratch(spark, "warc")
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    sample = [r[0].encode() for r in pages.where(F.octet_length("html").between(1, SAMPLE_BYTES)).select("html").limit(SAMPLES).collect()]
    dictionary = train_dictionary(sample)
    revisits = cut(record_types(pages).dropDuplicates(["page_id", "digest"]))
    few = revisits.count() <= 1_000_000
    rows = pages.withColumn("digest", F.unhex(F.sha2(F.coalesce("html", F.lit("")).cast("binary"), 256)))
    rows = rows.join(F.broadcast(revisits) if few else revisits, ["page_id", "digest"], "left").select("page_id", "url", "html", "refers_to")
    target = _uri(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fs, base = pafs.FileSystem.from_uri(target)
        task, done, writer = TaskContext.get(), [], None
        for b in sliced(batches):
            for page_id, url, html, refers_to in zip(*(b.column(i).to_pylist() for i in range(4))):
                if writer is None:
                    done.append(f"part-{task.partitionId():05d}-{task.taskAttemptId()}-{len(done):04d}.warc.zst")
                    writer = ArchiveWriter(fs.open_output_stream(f"{base}/{done[-1]}", compression=None), dictionary)
                writer.write(record(page_id, url, (html or "").encode(), "response" if refers_to is None else "revisit", refers_to))
                if writer.size >= archive_bytes:
                    writer.out.close()
                    writer = None
        if writer:
            writer.out.close()
        yield pa.RecordBatch.from_arrays([pa.array(done, pa.string())], ["name"])

    ship_code(spark)
    rows.mapInArrow(run, "name string").write.parquet(f"{path}/{MANIFEST}")
    return path


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of all archives of a folder: page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload.

    Where the folder has a manifest, only archives that it names are read. A record that fails validation fails the read.
    payload is null for revisits, and for all if payloads is false."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 1):
            for archive in b.column(0):
                some, size = [], 0
                for r in read_archive(archive.as_buffer()):
                    some.append(r if payloads else r | {"payload": None})
                    size += len(r["payload"] or b"")
                    if size > 8 << 20 or len(some) == 4096:
                        yield pa.RecordBatch.from_pylist(some, schema)
                        some, size = [], 0
                if some:
                    yield pa.RecordBatch.from_pylist(some, schema)

    ship_code(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(path)
    manifest = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{MANIFEST}")
    if manifest.getFileSystem(spark._jsc.hadoopConfiguration()).exists(manifest):
        names = spark.read.schema("name string").parquet(f"{path}/{MANIFEST}")
        few = names.count() <= BROADCAST_ROWS
        files = files.withColumn("name", F.element_at(F.split("path", "/"), -1)).join(F.broadcast(names) if few else names, "name", "left_semi")
    files = files.select("content")
    return files.mapInArrow(run, "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary")
