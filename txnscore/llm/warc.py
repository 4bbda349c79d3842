"""WARC archives: written with revisits for repeated payloads, read back in splits.

Writing: every task writes one archive of gzip members, one member per record, to the
given folder. A file appears under its final name only when it is whole, names are
unique to the attempt, and the list of files is written by the job, so what a lost
executor left behind is never read.

Reading: files are cut into byte ranges. A task looks for the gzip magic in its range,
takes a place as a member only if it decodes and begins with a WARC header, and owns
the records that start inside its range; the last one may end beyond it.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txnscore.session import fresh_path, materialize

MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1.1\r\n"
MOST_TASKS = 20_000
# Row numbers are looked up this many at a time; a task numbers its rows from a multiple of 2**33 on.
PART_ROWS = 1 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass(frozen=True)
class Split:
    """``size`` bytes of an archive make a task's range; files are read ``piece`` bytes at a time."""

    size: int = 8 << 20
    piece: int = 1 << 20


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path of the shared folder, and the path in it."""
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, fields: dict[str, str | None], payload: bytes) -> bytes:
    """One gzip member: header lines, an empty line, the payload, two line ends. NULL fields are left out."""
    lines = [f"WARC-Type: {kind}", *(f"{k}: {_escaped(v)}" for k, v in fields.items() if v is not None), f"Content-Length: {len(payload)}"]
    body = VERSION + "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + payload + b"\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(body) + packer.flush()


def _escaped(value: str) -> str:
    return value.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def _unescaped(value: str) -> str:
    return value.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")


def _fields(page: dict) -> dict[str, str | None]:
    number = None if page["page_id"] is None else str(page["page_id"])
    return {
        "WARC-Record-ID": f"<urn:page:{number}:{page['row']}>",
        "WARC-Target-URI": page["url"],
        "WARC-Payload-Digest": "sha1:" + page["digest"],
        "X-Page-Id": number,
        "WARC-Refers-To": None if page["refers"] is None else f"<urn:page:{page['refers']}>",
        "WARC-Profile": None if page["refers"] is None else PROFILE,
    }


class _Revisits:
    """What the rows of the part being read refer to; one part is held at a time."""

    def __init__(self, path: str):
        self.fs, self.path = _open(path)
        self.part, self.refers = None, {}

    def source(self, row: int) -> str | None:
        part = row - row % PART_ROWS
        if part != self.part:
            self.part, self.refers = part, {}
            folder = pafs.FileSelector(f"{self.path}/part={part}", allow_not_found=True)
            for file in self.fs.get_file_info(folder):
                if file.path.endswith(".parquet"):
                    found = pq.read_table(file.path, columns=["row", "refers"], filesystem=self.fs, partitioning=None)
                    self.refers.update(zip(found["row"].to_pylist(), found["refers"].to_pylist()))
        return self.refers.get(row)


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 0) -> DataFrame:
    """Write archives below ``folder``; returns their ``path``, ``length`` and ``records``.

    Payloads are the text in UTF-8 (NULL: empty). Of the records with one payload of at least
    ``least`` bytes that of the smallest id is a response (NULL ids last; of equal ids the
    first row), all others are revisits without a payload that refer to it.

    The rows are written once with a number each, and everything after reads that table, so
    a number means one row whatever is recomputed. Payloads are never shuffled: digests and
    ids settle which rows are revisits, these are stored in folders by the part of the
    table they are in, and a task looks up those of the parts it reads.
    """
    text = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.col(url_col).cast("string").alias("url"),
        text.alias("html"),
        F.sha1(text.cast("binary")).alias("digest"),
        F.octet_length(text).alias("size"),
        F.monotonically_increasing_id().alias("row"),
    )
    rows = materialize(rows, "warc-rows")
    narrow = rows.where(F.col("size") >= least).select("digest", "page_id", "row")
    rank = F.struct(F.coalesce("page_id", F.lit(2**63 - 1)).alias("id"), "row")
    first = narrow.groupBy("digest").agg(F.min(rank).alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    copies = narrow.join(first, "digest").where("row <> first.row")
    source = F.when(F.col("first.id") == 2**63 - 1, "None").otherwise(F.col("first.id").cast("string"))
    copies = copies.select((F.col("row") - F.col("row") % PART_ROWS).alias("part"), "row", F.concat_ws(":", source, F.col("first.row").cast("string")).alias("refers"))
    known = fresh_path(pages.sparkSession, "warc-revisits")
    copies.repartitionByRange("part", "row").sortWithinPartitions("part", "row").write.partitionBy("part").parquet(known)

    def archive(batches):
        fs, base = _open(folder)
        fs.create_dir(base, recursive=True)
        revisits = _Revisits(known)
        name = f"{base}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
        length = records = 0
        with fs.open_output_stream(name + ".open") as out:
            for batch in batches:
                for page in batch.to_pylist():
                    page["refers"] = revisits.source(page["row"])
                    payload = page["html"].encode("utf-8", "surrogatepass")
                    page["digest"] = sha1(payload)
                    part = record("response", _fields(page), payload) if page["refers"] is None else record("revisit", _fields(page), b"")
                    out.write(part)
                    length += len(part)
                    records += 1
        if records:
            fs.move(name + ".open", name)
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name.rpartition('/')[2]}"], "length": [length], "records": [records]})
        else:
            fs.delete_file(name + ".open")

    return materialize(rows.select("page_id", "url", "html", "row").mapInArrow(archive, "path string, length long, records long"), "warc-files")


class _Window:
    """A file seen through a moving buffer."""

    def __init__(self, file, length: int, piece: int):
        self.file, self.length, self.piece = file, length, piece
        self.base, self.data = 0, b""

    def read(self, at: int, size: int) -> bytes:
        """Up to ``size`` bytes from ``at``, fewer at the end of the file."""
        if not (self.base <= at and at + size <= self.base + len(self.data)):
            self.file.seek(at)
            self.base, self.data = at, self.file.read(min(max(size, self.piece), self.length - at))
        return self.data[at - self.base : at - self.base + size]


def _member(view: _Window, at: int) -> tuple[dict[str, str], bytes, int] | None:
    """Header fields, payload and end of the record that starts at ``at``, or None if none does."""
    unpack, parts, place, found = zlib.decompressobj(31), [], at, b""
    while not unpack.eof:
        chunk = view.read(place, 1 << 16)
        if not chunk:
            return None
        try:
            parts.append(unpack.decompress(chunk))
        except zlib.error:
            return None
        place += len(chunk)
        if len(found) < len(VERSION):
            found += parts[-1][: len(VERSION)]
            if not VERSION.startswith(found[: len(VERSION)]):
                return None
    head, line, rest = b"".join(parts).partition(b"\r\n\r\n")
    if not head.startswith(VERSION) or not line:
        return None
    fields = dict(x.split(": ", 1) for x in head[len(VERSION) :].decode("utf-8", "surrogatepass").split("\r\n"))
    size = fields.get("Content-Length", "")
    if not size.isdigit() or len(rest) != int(size) + 4:
        return None
    return fields, rest[: int(size)], place - len(unpack.unused_data)


def records(fs: pafs.FileSystem, path: str, length: int, start: int, stop: int, piece: int):
    """The records of an archive that start in [start, stop)."""
    with fs.open_input_file(path) as file:
        view = _Window(file, length, piece)
        at = start
        while at < stop:
            # The magic may begin in the range and end behind it.
            found = view.read(at, min(piece, stop - at + len(MAGIC) - 1)).find(MAGIC)
            if found < 0:
                at += min(piece, stop - at)
                at = at if at >= stop else at - len(MAGIC) + 1
                continue
            at += found
            member = _member(view, at)
            if member is None:
                at += 1
                continue
            fields, payload, at = member
            yield fields, payload


_READ = pa.schema(
    [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("record_id", pa.string()), ("refers", pa.string()), ("payload_digest", pa.string()), ("payload", pa.binary())]
)


def read(spark: SparkSession, files: DataFrame, split: Split = Split()) -> DataFrame:
    """The records of the archives ``files`` lists (path, length), in ranges of ``split.size`` bytes.

    Columns: page_id, url, record_type, record_id, refers (a record id), payload_digest (of the
    payload read; a revisit's is its header's) and payload (NULL for revisits). No file, no rows.
    """
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest("length", F.lit(1)) - 1, F.lit(split.size).cast("long")))
    ranges = files.select("path", "length", starts.alias("start"))
    # A range is a few numbers but much work: a task each, up to many thousands.
    count = ranges.count()
    ranges = ranges.repartition(min(max(1, count), MOST_TASKS))

    def run(batches):
        for batch in batches:
            for part in batch.to_pylist():
                fs, path = _open(part["path"])
                out = []
                for fields, payload in records(fs, path, part["length"], part["start"], min(part["start"] + split.size, part["length"]), split.piece):
                    page, url, refers = fields.get("X-Page-Id"), fields.get("WARC-Target-URI"), fields.get("WARC-Refers-To")
                    kind = fields["WARC-Type"]
                    out.append(
                        {
                            "page_id": None if page is None else int(page),
                            "url": None if url is None else _unescaped(url),
                            "record_type": kind,
                            "record_id": fields.get("WARC-Record-ID"),
                            "refers": refers,
                            "payload_digest": sha1(payload) if kind == "response" else fields.get("WARC-Payload-Digest", "").removeprefix("sha1:"),
                            "payload": payload if kind == "response" else None,
                        }
                    )
                    if len(out) == 256:
                        yield pa.RecordBatch.from_pylist(out, _READ)
                        out = []
                if out:
                    yield pa.RecordBatch.from_pylist(out, _READ)

    types = "page_id long, url string, record_type string, record_id string, refers string, payload_digest string, payload binary"
    return ranges.mapInArrow(run, types)


def round_trip(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 0, split: Split = Split()) -> DataFrame:
    """``pages`` written and read back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Sizes and digests are those of the payloads read; a revisit has them from the response it
    refers to. Every row has one record; NULL urls and payloads, empty payloads and NULL or
    repeated ids are records like others. An empty table writes nothing and reads nothing.
    """
    spark = pages.sparkSession
    files = write(pages, folder or fresh_path(spark, "warc"), id_col, url_col, payload_col, least)
    found = read(spark, files, split).select("page_id", "record_type", "record_id", "refers", F.octet_length("payload").cast("long").alias("payload_bytes"), "payload_digest")
    found = materialize(found, "warc-records")
    # Only responses that something refers to are looked up.
    sources = found.where("record_type = 'response'").select(F.col("record_id").alias("refers"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("source_bytes"))
    revisits = found.where("record_type = 'revisit'").drop("payload_bytes").join(sources, "refers", "left")
    one = found.where("record_type = 'response'").select("page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to"))
    two = revisits.select("page_id", F.col("source_bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
    return one.unionByName(two)
