"""WARC archives with a two-level capture index.

``write_archives`` writes one record a row, each a gzip member of its own, so that a record
is read by its offset and length alone.  Of equal payloads one is a response, the others
revisit it.  ``write_index`` sorts the captures by URL key (host reversed, so that a site's
captures stand together) into lines, packs them in gzip blocks, and keeps a sparse
directory: the first key of each block, its offset and its length.  ``lookup`` takes
URLs, finds the index parts by their first keys, binary-searches a part's directory, reads the
blocks that can hold the key, and gives the captures' places; ``fetch`` reads
those ranges of the archives.  ``scan`` reads whole archives from their beginning, with
or without compression.

Files lie in the shared folder and are written by tasks.  Their names hold the task's attempt,
and only what a finished attempt reports is in the tables of captures and parts, so
a lost executor or a repeated task leaves at most files that nothing names.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _kernels as K
from ._shared import Stage, small
from ._store import opened, read_ranges

ARCHIVE_BYTES = 1 << 30
#: Lines of an index block, and most lines of an index part on average.
BLOCK_LINES = 3000
PART_LINES = 1_000_000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

CAPTURES = "key string, id string, file string, offset long, length long, type string, digest string"
_CAPTURES = pa.schema([(n, pa.int64() if n in ("offset", "length") else pa.string()) for n in ("key", "id", "file", "offset", "length", "type", "digest")])
RECORDS = "id string, url string, date string, record_type string, payload_digest string, payload_bytes long, refers_to string, payload binary"
_END = b"\r\n\r\n"


class Record(NamedTuple):
    id: str | None
    url: str | None
    date: str | None
    record_type: str
    payload_digest: str | None
    payload_bytes: int
    refers_to: str | None
    payload: bytes | None


def url_key(url: str | None) -> str:
    """The key under which a URL is indexed: ``com,example,blog)/path?query`` for
    ``http://user@Blog.example.com:80/path?query#part``; scheme, user, default port and fragment
    are left out, the host is lower-cased and reversed.  Other URLs are their own key,
    a null or empty one is ``-``; white space and control characters are escaped."""
    url = re.sub(r"#.*", "", (url or "").strip(), flags=re.S)
    url = re.sub(r"[\x00-\x20\x7F-\xA0]", lambda m: quote(m[0]), url)
    found = re.match(r"(?i:https?)://([^/?]*)(.*)", url)
    if not found:
        return url or "-"
    host, port = re.fullmatch(r"(.*?)(:\d*)?", found[1].rpartition("@")[2]).groups()
    labels = host.lower().strip(".").split(".")
    rest = found[2] if found[2].startswith("/") else "/" + found[2]
    return ",".join(reversed(labels)) + (port if port and port not in (":", ":80", ":443") else "") + ")" + rest


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(record_id: str | None) -> str:
    return "<urn:capture:null>" if record_id is None else f"<urn:capture:id:{quote(record_id, safe='')}>"


def _from_urn(urn: str | None) -> str | None:
    """The id that a record's name holds; a foreign record's id is its name."""
    found = re.fullmatch(r"<urn:capture:(null|id:(.*))>", urn or "", re.S)
    return urn if not found else None if found[1] == "null" else unquote(found[2])


def _member(fields: dict[str, str | None], block: bytes, level: int) -> bytes:
    """A record as a gzip member."""
    lines = "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None)
    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
    return pack.compress(f"WARC/1.1\r\n{lines}Content-Length: {len(block)}\r\n\r\n".encode()) + pack.compress(block) + pack.compress(_END) + pack.flush()


def _capture(row: dict, payload: bytes, date: str, level: int) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    line = lambda url: re.sub(r"[\x00-\x20\x7F]", lambda m: quote(m[0]), url) if url else None
    again = row["type"] == "revisit"
    fields = {
        "WARC-Type": row["type"],
        "WARC-Record-ID": _urn(row["id"]),
        "WARC-Date": date,
        "WARC-Target-URI": line(row["url"]),
        "WARC-Payload-Digest": f"sha1:{row['digest']}",
        "WARC-Profile": PROFILE if again else None,
        "WARC-Refers-To": _urn(row["refers_to"]) if again else None,
        "WARC-Refers-To-Target-URI": line(row["refers_url"]) if again else None,
        "Content-Type": "application/http;msgtype=response",
    }
    return _member(fields, http if again else http + payload, level)


def parsed(data: bytes, verify: bool = True) -> Record:
    """The record that the bytes hold; raises if they aren't one whole record or, where asked
    to verify, if the payload hasn't the digest that its head names."""
    head, found, rest = data.partition(_END)
    lines = head.decode("utf-8", "surrogateescape").split("\r\n")
    if not found or not lines[0].startswith("WARC/"):
        raise ValueError(f"no WARC record: {data[:60]!r}")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    size = int(fields["content-length"])
    if len(rest) < size:
        raise ValueError(f"a record of {size} bytes ends after {len(rest)}")
    block, kind, digest = rest[:size], fields.get("warc-type", ""), fields.get("warc-payload-digest", "")
    payload, length = block, size
    if fields.get("content-type", "").replace(" ", "").startswith("application/http"):
        http, _, payload = block.partition(_END)
        told = re.search(rb"(?im)^content-length:\s*(\d+)", http)
        length = int(told[1]) if told else len(payload)
    if kind == "revisit":
        payload = None
    elif verify and digest.startswith("sha1:") and base32_sha1(payload) != digest[5:]:
        raise ValueError(f"{fields.get('warc-record-id')}: the payload hasn't the digest {digest}")
    return Record(_from_urn(fields.get("warc-record-id")), fields.get("warc-target-uri"), fields.get("warc-date"), kind, digest.removeprefix("sha1:") or None, length, _from_urn(fields.get("warc-refers-to")), payload)


def _tasks(spark: SparkSession) -> int:
    """Tasks that read or write files; stated, as rows are narrow here and files aren't."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


class _Archive:
    """Files that one task writes, a new one where the last is full."""

    def __init__(self, root: str, name: str, suffix: str, limit: int) -> None:
        self.root, self.suffix, self.limit, self.n = root, suffix, limit, 0
        task = TaskContext.get()
        self.name = f"{name}-{task.partitionId():06d}-{task.taskAttemptId()}"
        self.out = None

    def add(self, data: bytes, first: bytes = b"") -> tuple[str, int]:
        """Appends the bytes; tells the file and the offset.  A new file begins with ``first``."""
        if self.out is None:
            self.n += 1
            self.uri = f"{self.root}/{self.name}-{self.n}.{self.suffix}"
            fs, path = opened(self.uri)
            fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
            self.out, self.at = fs.open_output_stream(path, compression=None), len(first)
            self.out.write(first)
        offset, uri = self.at, self.uri
        self.out.write(data)
        self.at += len(data)
        if self.at >= self.limit:
            self.close()
        return uri, offset

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None


def typed(pages: DataFrame, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """id, url, payload, digest (hex), type, refers_to and refers_url of each row.

    Of the payloads of ``least_bytes`` or more that are equal (in SHA-1 and length), those
    with the largest id are responses, the others revisit it; all else is a response."""
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("size", F.octet_length("payload"))
    copies = rows.where(F.col("size") >= least_bytes).groupBy("digest", "size").agg(F.count("*").alias("n"), F.max(F.struct("id", "url")).alias("last"))
    copies = small(copies.where("n > 1 and last.id is not null").select("digest", "size", F.col("last.id").alias("last_id"), F.col("last.url").alias("last_url")))
    found = rows.join(copies, ["digest", "size"], "left")
    again = F.col("last_id").isNotNull() & ~F.col("id").eqNullSafe(F.col("last_id"))
    return found.select("id", "url", "payload", "digest", F.when(again, "revisit").otherwise("response").alias("type"), F.when(again, F.col("last_id")).alias("refers_to"), F.when(again, F.col("last_url")).alias("refers_url"))


def _slices(batch: pa.RecordBatch, column: str = "payload") -> Iterator[pa.RecordBatch]:
    """Consecutive rows of a batch that hold some MB of payload, one row at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < batch.num_rows:
        before = int(ends[start - 1]) if start else 0
        to = max(start + 1, int(np.searchsorted(ends, before + K.PIECE_BYTES, "right")))
        yield batch.slice(start, to - start)
        start = to


def write_archives(rows: DataFrame, root: str, date: str = DATE, level: int = 6, limit: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes a record for each row of ``typed`` and gives its capture; runs with the action
    on what it returns, which has to be saved once."""
    info = "software: codexloom\r\nformat: WARC File Format 1.1\r\n".encode()

    def write(batches):
        out = _Archive(root, "archive", "warc.gz", limit)
        first = _member({"WARC-Type": "warcinfo", "WARC-Record-ID": f"<urn:capture:info:{out.name}>", "WARC-Date": date, "Content-Type": "application/warc-fields"}, info, level)
        try:
            for batch in batches:
                for part in _slices(batch):
                    made = []
                    for row in part.to_pylist():
                        row["digest"] = base64.b32encode(bytes.fromhex(row["digest"])).decode()
                        data = _capture(row, row["payload"], date, level)
                        made.append((url_key(row["url"]), row["id"], *out.add(data, first), len(data), row["type"], row["digest"]))
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made, strict=True), _CAPTURES, strict=True)], schema=_CAPTURES)
        finally:
            out.close()

    as_text = [F.col(c).cast("string").alias(c) for c in ("id", "refers_to")]
    return rows.select(*as_text, "url", "payload", "digest", "type", "refers_url").mapInArrow(write, CAPTURES)


_PARTS = "first_key string, index string, directory string, lines long"


def write_index(captures: DataFrame, root: str, block_lines: int = BLOCK_LINES, part_lines: int = PART_LINES) -> DataFrame:
    """Writes the sorted index and gives its parts: first key, file of blocks and file of the
    directory.  Runs with the action on what it returns, which has to be saved once.

    Parts are ranges of (key, id, place), so the captures of one key can fill many."""
    spark = captures.sparkSession
    parts = max(_tasks(spark), -(-captures.count() // part_lines))
    order = ["key", "id", "file", "offset"]

    def write(batches):
        blocks = _Archive(root, "index", "cdx.gz", 1 << 62)
        directory, lines, first, total = [], [], None, 0

        def flush():
            nonlocal lines, total
            pack = zlib.compressobj(9, zlib.DEFLATED, 31)
            data = pack.compress("".join(x + "\n" for x in lines).encode()) + pack.flush()
            uri, offset = blocks.add(data)
            directory.append(f"{lines[0].partition(' ')[0]} {offset} {len(data)} {len(lines)}")
            total, lines = total + len(lines), []
            return uri

        uri = None
        for batch in batches:
            for row in batch.to_pylist():
                first = row["key"] if first is None else first
                lines.append(f"{row.pop('key')} {json.dumps(row)}")
                if len(lines) == block_lines:
                    uri = flush()
        if lines:
            uri = flush()
        blocks.close()
        if uri:
            at = uri.removesuffix(".cdx.gz") + ".idx"
            fs, path = opened(at)
            with fs.open_output_stream(path, compression=None) as out:
                out.write("\n".join(directory).encode())
            yield pa.RecordBatch.from_pydict({"first_key": [first], "index": [uri], "directory": [at], "lines": [total]})

    return captures.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(write, _PARTS)


class _Part:
    """The directory of an index part, and the block that was read last."""

    def __init__(self, index: str, directory: str) -> None:
        fs, path = opened(directory)
        with fs.open_input_stream(path, compression=None) as source:
            rows = [x.rsplit(" ", 3) for x in source.read().decode().split("\n")]
        self.index = index
        self.keys, self.places = [r[0] for r in rows], [(int(r[1]), int(r[2])) for r in rows]
        self.last: tuple[int, list[str], list[str]] | None = None

    def block(self, k: int) -> tuple[list[str], list[str]]:
        if self.last is None or self.last[0] != k:
            [(_, data)] = read_ranges([(self.index, *self.places[k], None)])
            lines = zlib.decompress(data, 31).decode().split("\n")[:-1]
            self.last = (k, [x.partition(" ")[0] for x in lines], lines)
        return self.last[1:]

    def captures(self, key: str) -> Iterator[dict]:
        """Captures of the key, a block at a time."""
        k = max(0, bisect.bisect_left(self.keys, key) - 1)
        while k < len(self.keys) and self.keys[k] <= key:
            keys, lines = self.block(k)
            for i in range(bisect.bisect_left(keys, key), bisect.bisect_right(keys, key)):
                yield json.loads(lines[i].partition(" ")[2])
            k += 1


def lookup(parts: DataFrame, urls: DataFrame, url_col: str = "url") -> DataFrame:
    """Captures of the keys of the given URLs (each key once): key, id, file, offset, length,
    type and digest.

    What tasks get of the index is the first key and the names of each part, one row a
    million captures; directories and blocks are read in ranges.  A key whose captures fill
    many parts is looked up by a task for each."""
    known = sorted((r["first_key"], r["index"], r["directory"]) for r in parts.select("first_key", "index", "directory").collect())
    firsts = [x[0] for x in known]

    def keys(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"key": pa.array([url_key(x) for x in batch.column(0).to_pylist()], pa.string())})

    def place(batches):
        for batch in batches:
            rows = [(key, p) for key in batch.column(0).to_pylist() for p in range(max(0, bisect.bisect_left(firsts, key) - 1), bisect.bisect_right(firsts, key))]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64())], ["key", "part"])

    def read(batches):
        part, at = None, None
        for batch in batches:
            found = []
            for key, p in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if p != at:
                    part, at = _Part(*known[p][1:]), p
                for row in part.captures(key):
                    found.append({"key": key, **row})
                    if len(found) == BLOCK_LINES:
                        yield pa.RecordBatch.from_pylist(found, _CAPTURES)
                        found = []
            if found:
                yield pa.RecordBatch.from_pylist(found, _CAPTURES)

    wanted = urls.select(F.col(url_col).alias("url")).mapInArrow(keys, "key string").distinct()
    placed = wanted.mapInArrow(place, "key string, part long")
    return placed.repartitionByRange(_tasks(urls.sparkSession), "part", "key").sortWithinPartitions("part", "key").mapInArrow(read, CAPTURES)


def _batches(found: Iterator[Record], with_payload: bool) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([(n, pa.int64() if n == "payload_bytes" else pa.binary() if n == "payload" else pa.string()) for n in Record._fields])
    held, size = [], 0
    for record in found:
        size += len(record.payload or b"") + 500
        held.append((record if with_payload else record._replace(payload=None))._asdict())
        if size > K.PIECE_BYTES:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def fetch(captures: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records at the captures' places, read in ranges in the order of the archives."""

    def read(batches):
        places = ((f, o, n, None) for b in batches for f, o, n in zip(*(c.to_pylist() for c in b.columns), strict=True))
        yield from _batches((parsed(zlib.decompress(data, 31)) for _, data in read_ranges(places)), with_payload)

    places = captures.select("file", "offset", "length")
    return places.repartitionByRange(_tasks(captures.sparkSession), "file", "offset").sortWithinPartitions("file", "offset").mapInArrow(read, RECORDS)


def _members(source, chunk: int = 1 << 20) -> Iterator[bytes]:
    """Records of an archive from its beginning, one gzip member or one plain record each."""
    data = source.read(chunk)
    if data[:2] != b"\x1f\x8b":
        while data:
            while _END not in data and (more := source.read(chunk)):
                data += more
            head, found, _ = data.partition(_END)
            size = re.search(rb"(?im)^content-length:\s*(\d+)", head)
            if not found or not size:
                raise ValueError(f"no WARC record: {data[:60]!r}")
            whole = len(head) + 4 + int(size[1]) + 4
            while len(data) < whole and (more := source.read(max(chunk, whole - len(data)))):
                data += more
            yield data[:whole]
            data = data[whole:] or source.read(chunk)
        return
    while data:
        pack, out = zlib.decompressobj(31), []
        while not pack.eof:
            if not data and not (data := source.read(chunk)):
                raise ValueError("the archive ends inside a record")
            out.append(pack.decompress(data))
            data = pack.unused_data
        yield b"".join(out)
        data = data or source.read(chunk)


def scan(files: DataFrame, file_col: str = "file", with_payload: bool = True, verify: bool = False) -> DataFrame:
    """All records of whole archives (but their ``warcinfo``), an archive a task."""

    def read(batches):
        def records():
            for batch in batches:
                for uri in batch.column(0).to_pylist():
                    fs, path = opened(uri)
                    with fs.open_input_stream(path, compression=None) as source:
                        yield from (r for r in (parsed(x, verify) for x in _members(source)) if r.record_type != "warcinfo")

        yield from _batches(records(), with_payload)

    names = files.select(F.col(file_col).alias("file")).distinct()
    return names.repartition(max(1, names.count()), "file").mapInArrow(read, RECORDS)


def archive_and_read(pages: DataFrame, least_bytes: int = 0, with_payload: bool = True, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Writes a record for each page and its index, looks every page's URL up and reads the
    records back: id, url, record_type, payload_digest (base32 SHA-1), payload_bytes,
    refers_to and payload (null for revisits, or if not asked for).

    A null payload is empty.  Of payloads of ``least_bytes`` or more that are equal, the one
    with the largest id is a response and the others revisit it; rows that repeat that id
    are responses, too.  Rows with a null id are never referred to, but may revisit; where all
    equal ones have null ids, all are responses.  A null or empty URL is written without a target and
    indexed as ``-``; one with white space or control characters is escaped.  Very long
    payloads are one record each; an empty table gives no rows; other columns are left out.
    """
    spark = pages.sparkSession
    stage = Stage(spark, "warc")
    kind = pages.schema[id_col].dataType
    root = str(stage.fs.makeQualified(spark._jvm.org.apache.hadoop.fs.Path(stage.root)).toString())
    captures = stage.save(write_archives(typed(pages, least_bytes, id_col, url_col, payload_col), f"{root}/archives"))
    parts = stage.save(write_index(captures, f"{root}/index"))
    found = fetch(stage.save(lookup(parts, pages, url_col)), with_payload)
    return found.select(F.col("id").cast(kind).alias(id_col), "url", "record_type", "payload_digest", "payload_bytes", F.col("refers_to").cast(kind).alias("refers_to"), "payload")
