"""WARC archives: writing pages, normalising archives of one gzip stream to a member for each record, and reading by offset.

Many crawlers compress a whole archive as one gzip stream, from which no record can be read without inflating all before it.
normalise() inflates each such file once, in pieces, copies every record into a gzip member of its own and writes a sidecar
index of offsets and lengths next to the new archive. read() then opens archives at the offsets of the index, so records of
one archive can be read by many tasks, and each alone.

archive() writes a record for each page: of equal payloads from LEAST bytes on, the one with the largest page_id is a response and
the others are revisits that refer to it; smaller ones are all responses. Which is which is decided on digests; classes with
many rows are looked up by broadcast, so no payload moves to a hot task.

Tasks write files under names of their own attempt, through pyarrow's file systems, to the folder that all share. A file
counts only if the table that the write commits names it; what a lost task leaves behind is never read.

Defined results: a null html is an empty payload, a null url gives a record without a target, a null page_id ranks below every
other. Rows that repeat the largest page_id of their class are all responses. Signs that would end a header line are written as
%XX in targets. Empty tables give no archives and no rows. Extra columns are ignored. A file that breaks off or isn't WARC
keeps the whole records before the fault, and its row in the list of archives says what the fault is.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lastrum.llm.shared import HEAVY, save, shared_dir, small
from lastrum.llm.words import slices

#: Payloads of fewer bytes are never revisits.
LEAST = 1000
#: Bytes of payload after which an archive ends and the next begins; a larger record makes its archive larger.
ROLL = 1 << 26
#: Compressed bytes that a task reads back.
SPAN = 1 << 24
#: Level of compression, and bytes that are inflated at once.
LEVEL, PIECE = 4, 1 << 20
#: Most bytes of a record's header.
MOST_HEADER = 1 << 20
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ARCHIVES = "archive string, sidecar string, source string, records long, bytes long, error string"
INDEX = "archive string, offset long, length long, record_type string, record_id string, target string"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def kinds(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload, refers_to) of each page: refers_to is null for a response. Payloads are the same if their SHA-256 is."""
    payload = F.coalesce(pages["html"].cast("string"), F.lit("")).cast("binary")
    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), payload.alias("payload"))
    large = F.octet_length("payload") >= LEAST
    digest = F.unhex(F.sha2("payload", 256))
    classes = save(rows.where(large).groupBy(digest.alias("sha")).agg(F.max("page_id").alias("keep"), F.count("*").alias("n")).where("n > 1 AND keep IS NOT NULL"), "classes")
    cut = max(2, rows.count() // HEAVY)
    heavy, light = (classes.where(test).select(F.col("sha").alias(f"{tag}_sha"), F.col("keep").alias(f"{tag}_keep")) for tag, test in (("heavy", F.col("n") >= cut), ("light", F.col("n") < cut)))
    own = F.concat(F.lit("-").cast("binary"), F.monotonically_increasing_id().cast("string").cast("binary"))
    keyed = rows.withColumn("sha", F.when(large, digest)).join(F.broadcast(heavy), F.col("sha") == F.col("heavy_sha"), "left")
    # what can't be in a light class gets a key of its own, so that no key is hot
    keyed = keyed.withColumn("key", F.when(F.col("sha").isNotNull() & F.col("heavy_sha").isNull(), F.col("sha")).otherwise(own))
    found = keyed.join(small(light.withColumn("light_sha", F.hex("light_sha"))), F.hex("key") == F.col("light_sha"), "left")
    keep = F.coalesce("heavy_keep", "light_keep")
    return found.select("page_id", "url", "payload", F.when(F.col("page_id").eqNullSafe(keep), F.lit(None).cast("long")).otherwise(keep).alias("refers_to"))


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}:{digest}').urn}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str = DATE) -> bytes:
    """A record in full. A revisit has the header of the response without its payload."""
    digest = hashlib.sha1(payload).hexdigest()
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block += payload if refers_to is None else b""
    lines = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": _record_id(page_id, digest),
        "WARC-Date": date,
        "WARC-Target-URI": None if url is None else re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url),
        "WARC-Payload-Digest": f"sha1:{digest}",
        "WARC-Page-ID": page_id,
        "WARC-Profile": None if refers_to is None else PROFILE,
        "WARC-Refers-To": None if refers_to is None else _record_id(refers_to, digest),
        "WARC-Refers-To-Page-ID": refers_to,
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": len(block),
    }
    return "".join(["WARC/1.1\r\n", *(f"{k}: {v}\r\n" for k, v in lines.items() if v is not None), "\r\n"]).encode() + block + b"\r\n\r\n"


def _table(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [x.split() for x in schema.split(", ")]
    kinds_ = {"string": pa.string(), "long": pa.int64()}
    return pa.RecordBatch.from_arrays([pa.array(list(c), kinds_[k]) for c, (_, k) in zip(zip(*rows, strict=True) if rows else [[] for _ in fields], fields, strict=True)], [n for n, _ in fields])


def _written(batches: Iterable[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    """Archives of one gzip stream each."""
    files, root = FileSystem.from_uri(folder)
    sink, taken = None, uuid.uuid4().hex
    k = n = size = 0

    def ended() -> pa.RecordBatch:
        sink.write(packer.flush())
        sink.close()
        return _table([(f"{folder}/{name}", n)], "archive string, records long")

    for batch in slices(batches, 64):
        for row in batch.to_pylist():
            if sink is None:
                name, packer = f"{taken}-{k}.warc.gz", zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                sink, n, size, k = files.open_output_stream(f"{root}/{name}", compression=None), 0, 0, k + 1
            sink.write(packer.compress(record(row["page_id"], row["url"], row["payload"], row["refers_to"])))
            n, size = n + 1, size + len(row["payload"])
            if size >= ROLL:
                yield ended()
                sink = None
    if sink is not None:
        yield ended()


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one. Spark makes it, so tasks need only write files."""
    found = f"{shared_dir(spark).rstrip('/')}/lastrum/{uuid.uuid4().hex}/{name}"
    path = spark._jvm.org.apache.hadoop.fs.Path(found)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
    return found


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def archive(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes archives of one gzip stream each to folder; gives (archive, records) of each."""
    folder = folder or _folder(pages.sparkSession, "streams")
    return save(kinds(pages).mapInArrow(lambda batches: _written(batches, folder), "archive string, records long"), "archives")


class Inflated:
    """The bytes of a gzip file, of one stream or several, piece by piece."""

    def __init__(self, source) -> None:
        self.source, self.packed, self.held, self.inner, self.begun = source, b"", b"", zlib.decompressobj(31), False

    def more(self) -> bool:
        """Inflates another piece; False at the end of the file."""
        while True:
            if self.inner.eof:
                self.packed = (self.inner.unused_data or self.packed).lstrip(b"\0")
                self.inner, self.begun = zlib.decompressobj(31), False
            while not self.packed and (got := self.source.read(PIECE)):
                self.packed = got if self.begun else got.lstrip(b"\0")  # padding between streams
            if not self.packed:
                if self.begun:
                    raise ValueError("a gzip stream breaks off")
                return False
            self.begun = True
            try:
                piece = self.inner.decompress(self.packed, PIECE)
            except zlib.error as fault:
                raise ValueError(f"no gzip: {fault}") from fault
            self.packed = self.inner.unconsumed_tail
            if piece:
                self.held += piece
                return True

    def head(self) -> bytes | None:
        """The header of the next record with the empty line that ends it; None if no record follows."""
        end = -1
        while end < 0:
            self.held = self.held.lstrip(b"\r\n")
            end = self.held.find(b"\r\n\r\n")
            if end < 0:
                if len(self.held) > MOST_HEADER:
                    raise ValueError("a header without an end")
                if not self.more():
                    if self.held:
                        raise ValueError("the file ends in a header")
                    return None
        head, self.held = self.held[: end + 4], self.held[end + 4 :]
        if not head.startswith(b"WARC/"):
            raise ValueError("no WARC record")
        return head

    def take(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.held and not self.more():
                raise ValueError("the file ends in a record")
            piece, self.held = self.held[:n], self.held[n:]
            n -= len(piece)
            yield piece


def headers(head: bytes) -> dict[str, str]:
    """Field names in lower case; a line that begins with white space continues the one before."""
    found: dict[str, str] = {}
    name = None
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and name:
            found[name] += " " + line.strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            name = name.strip().lower()
            found[name] = value.strip()
    return found


def _length(fields: dict[str, str]) -> int:
    if not fields.get("content-length", "").isdecimal():
        raise ValueError("a record without a length")
    return int(fields["content-length"])


def members(source, sink) -> Iterator[tuple[int, int, dict[str, str]]]:
    """Copies each record of source to a gzip member of its own; gives (offset, length, header) of each that is whole.

    A record's bytes reach the sink only when the whole record was read, unless it is larger than ROLL.
    """
    stream, offset = Inflated(source), sink.tell()
    while (head := stream.head()) is not None:
        fields, packer, held = headers(head), zlib.compressobj(LEVEL, zlib.DEFLATED, 31), 0
        parts = [packer.compress(head)]
        for piece in stream.take(_length(fields)):
            parts.append(packer.compress(piece))
            held += len(parts[-1])
            if held > ROLL:
                sink.write(b"".join(parts))
                parts, held = [], 0
        parts += [packer.compress(b"\r\n\r\n"), packer.flush()]
        sink.write(b"".join(parts))
        length = sink.tell() - offset
        yield offset, length, fields
        offset += length


def _line(name: str, offset: int, length: int, fields: dict[str, str]) -> str:
    return "\t".join([name, str(offset), str(length), *(re.sub(r"[\t\r\n\\]", " ", fields.get(x, "")) for x in ("warc-type", "warc-record-id", "warc-target-uri"))]) + "\n"


def _normalised(path: str, folder: str) -> tuple:
    """A row of ARCHIVES for the archive at path."""
    files, place = FileSystem.from_uri(path)
    out, root = FileSystem.from_uri(folder)
    name = f"{uuid.uuid4().hex}.warc.gz"
    n, error = 0, None
    with files.open_input_stream(place, compression=None) as source, out.open_output_stream(f"{root}/{name}", compression=None) as sink, out.open_output_stream(f"{root}/{name}.idx", compression=None) as index:
        try:
            for offset, length, fields in members(source, sink):
                index.write(_line(f"{folder}/{name}", offset, length, fields).encode())
                n += 1
        except ValueError as fault:
            error = str(fault)
        size = sink.tell()
    return f"{folder}/{name}", f"{folder}/{name}.idx", path, n, size, error


def normalise(archives: DataFrame, folder: str | None = None) -> DataFrame:
    """For each row of archives(archive, ...) writes an archive with a member for each record, and its index; gives ARCHIVES, the list of
    both. One task inflates a file as a stream and holds a piece of it."""
    spark = archives.sparkSession
    folder = folder or _folder(spark, "members")

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("archive").to_pylist():
                yield _table([_normalised(path, folder)], ARCHIVES)

    paths = archives.select("archive")
    return save(paths.repartition(max(1, min(paths.count(), 100_000))).mapInArrow(each, ARCHIVES), "normalised")


def read_index(spark: SparkSession, archives: DataFrame) -> DataFrame:
    """INDEX, from the sidecars that archives (as of normalise()) lists; those of tasks that were lost are left out."""
    folders = [r["folder"] for r in archives.select(F.regexp_replace("sidecar", "[^/]*$", "").alias("folder")).distinct().collect()]  # one for each call of normalise()
    if not folders:
        return spark.createDataFrame([], INDEX)
    lines = spark.read.option("sep", "\t").option("quote", "").option("pathGlobFilter", "*.idx").schema(INDEX).csv(folders)
    return lines.join(small(archives.select("archive")), "archive", "left_semi")


def parsed(packed: bytes) -> tuple:
    """A row of RECORDS from a member. The payload of a response must have the length and digest that its header gives."""
    stream = Inflated(pa.BufferReader(packed))
    fields = headers(stream.head())
    pieces, http = stream.take(_length(fields)), b""
    while b"\r\n\r\n" not in http:
        http += next(pieces)
    http, _, rest = http.partition(b"\r\n\r\n")
    digest, size = hashlib.sha1(rest), len(rest)
    for piece in pieces:
        digest.update(piece)
        size += len(piece)
    said, kind = fields["warc-payload-digest"].removeprefix("sha1:"), fields["warc-type"]
    stated = int(headers(http + b"\r\n")["content-length"])
    if kind == "response" and (size, digest.hexdigest()) != (stated, said):
        raise ValueError(f"record {fields['warc-record-id']} is damaged")
    page_id, refers_to = (int(fields[k]) if k in fields else None for k in ("warc-page-id", "warc-refers-to-page-id"))
    return page_id, stated, said, kind, refers_to


def read(spark: SparkSession, archives: DataFrame) -> DataFrame:
    """RECORDS of all records in archives (as of normalise()), each read at its offset."""
    size = archives.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first()["bytes"]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // SPAN + 1)
    index = read_index(spark, archives).select("archive", "offset", "length")
    spread = index.repartition(parts, "archive", F.floor(F.col("offset") / SPAN)).sortWithinPartitions("archive", "offset")

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, source = None, None
        for batch in slices(batches):
            rows = []
            for row in batch.to_pylist():
                if row["archive"] != at:
                    if source:
                        source.close()
                    files, place = FileSystem.from_uri(row["archive"])
                    at, source = row["archive"], files.open_input_file(place)
                rows.append(parsed(source.read_at(row["length"], row["offset"])))
            yield _table(rows, RECORDS)

    return spread.mapInArrow(each, RECORDS)


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes pages as archives of one stream, normalises them, and reads all records back by the index: RECORDS."""
    spark = pages.sparkSession
    folder = _folder(spark, "streams")
    archives = normalise(archive(pages, folder))
    if faults := archives.where("error IS NOT NULL").limit(3).collect():
        raise ValueError(f"archives that can't be normalised: {faults}")
    _delete(spark, folder)
    return read(spark, archives)
