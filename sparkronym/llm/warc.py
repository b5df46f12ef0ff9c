"""WARC archives of pages and their two-level capture index.

Writing: each task appends records, one gzip member each, to files of its own, and
reports where each is. Payloads that equal an earlier page's become revisit records.

Index: captures are sorted by the page's key, its URL with the host's parts reversed,
and cut into blocks of BLOCK_LINES lines, each compressed. An index file holds blocks of
a range of keys and, last, its block directory: the first key, offset and length of each
block. The table of index files (first key, place of the directory) is all that is
broadcast: a row for each file, not for each block or page.

Lookup: binary search in the table of files, then in a file's directory, then in the
one block's lines; only then ranges of archives are read, neighbours together.

Archives and index files are in the shared folder, opened by their URI with pyarrow.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote, urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkronym.llm.common import Scratch, ship

#: Lines of an index block, bytes of an archive at which the next begins, and bytes read at once.
BLOCK_LINES, FILE_BYTES, READ_BYTES = 1000, 1 << 28, 4 << 20
DATE = "2024-01-01T00:00:00Z"
CAPTURE = "key string, page_id string, file string, offset long, length long"
RECORD = "page_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string, payload binary"


def url_key(url: str | None) -> str:
    """The URL with its host's parts reversed, without scheme, user, default port and fragment; what is no URL stays as it is."""
    if url is None:
        return ""
    try:
        u = urlsplit(url)
        host, port = u.hostname, u.port
    except ValueError:
        return url
    if not host:
        return url
    at = ",".join(reversed(host.split("."))) + (f":{port}" if port and port != {"http": 80, "https": 443}.get(u.scheme) else "")
    return f"{at}){u.path or '/'}" + (f"?{u.query}" if u.query else "")


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def base32_sha1(c: Column) -> Column:
    """The same in Spark: five hexadecimal digits are four of base 32."""
    h = F.sha1(F.encode(c, "UTF-8"))
    part = [F.lpad(F.conv(F.substring(h, 10 * k + 1, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*part), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def open_fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def urn(page_id: str | None) -> str:
    """A name for a page; that of no page_id is like none of an id."""
    return "<urn:page>" if page_id is None else f"<urn:page:{quote(page_id)}>"


def page_of(name: str | None) -> str | None:
    return None if name is None or name == "<urn:page>" else unquote(name.removeprefix("<urn:page:").removesuffix(">"))


def record(page_id: str | None, url: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """A WARC record: an HTTP response, or a revisit that has the response's head only."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {urn(page_id)}", f"WARC-Date: {DATE}",
        *([] if url is None else ["WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A")]), f"WARC-Payload-Digest: sha1:{digest}",
        *([] if refers_to is None else ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {urn(refers_to)}"]),
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """What a record says; the payload's digest is checked where it has one."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    h = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    block = rest[: int(h["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    got = {"page_id": page_of(h["warc-record-id"]), "url": h.get("warc-target-uri"), "payload_bytes": size, "payload_digest": h["warc-payload-digest"].removeprefix("sha1:"), "record_type": h["warc-type"], "refers_to": page_of(h.get("warc-refers-to")), "payload": None}
    if h["warc-type"] == "response":
        if len(payload) != size or digest_of(payload) != got["payload_digest"]:
            raise ValueError(f"record {h['warc-record-id']} is damaged")
        got["payload"] = payload
    return got


def _rows(rows: list, schema: str) -> pa.RecordBatch:
    names = [x.split()[0] for x in schema.split(", ")]
    types = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    cols = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, types[x.split()[1]]) for c, x in zip(cols, schema.split(", "), strict=True)], names=names)


def _write(folder: str, file_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_fs(folder)
        fs.create_dir(root, recursive=True)
        out, name, at = None, "", 0
        for batch in batches:
            rows = []
            for page_id, url, html, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None or at >= file_bytes:
                    if out is not None:
                        out.close()
                    # a name of its own for each attempt: what a lost task has written is in no table
                    name, at = f"pages-{uuid.uuid4().hex}.warc.gz", 0
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                data = gzip.compress(record(page_id, url, (html or "").encode(), digest, refers_to), 6, mtime=0)
                out.write(data)
                rows.append((url_key(url), page_id, name, at, len(data)))
                at += len(data)
            yield _rows(rows, CAPTURE)
        if out is not None:
            out.close()

    return run


FILES = "first_key string, file string, offset long, length long"


def _index(folder: str, lines: int):
    """Writes the sorted captures of a partition as one index file; a row about it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_fs(folder)
        fs.create_dir(root, recursive=True)
        name, at, out, directory, held = f"captures-{uuid.uuid4().hex}.idx", 0, None, [], []

        def flush(at: int) -> int:
            data = zlib.compress("\n".join(json.dumps(x) for x in held).encode(), 6)
            out.write(data)
            directory.append((held[0][0], at, len(data)))
            return at + len(data)

        for batch in batches:
            for x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                held.append(x)
                if len(held) == lines:
                    at, held = flush(at), []
        if held:
            at = flush(at)
        if out is None:
            return
        data = zlib.compress(json.dumps(directory).encode(), 6)
        out.write(data)
        out.close()
        yield _rows([(directory[0][0], name, at, len(data))], FILES)

    return run


class Index:
    """Binary search in an index whose table of files is given, sorted by first key."""

    def __init__(self, folder: str, files: list[tuple[str, str, int, int]]):
        self.fs, self.root = open_fs(folder)
        self.files, self.firsts = files, [f[0] for f in files]
        self.directories: dict = {}
        self.block: tuple = (None, None, None)

    def _read(self, name: str, offset: int, length: int) -> bytes:
        with self.fs.open_input_file(f"{self.root}/{name}") as f:
            return zlib.decompress(f.read_at(length, offset))

    @staticmethod
    def _from(firsts: list[str], key: str) -> Iterator[int]:
        """Places whose range may hold the key: from the last that begins before it on."""
        k = max(0, bisect.bisect_left(firsts, key) - 1)
        while k < len(firsts) and firsts[k] <= key:
            yield k
            k += 1

    def places(self, key: str) -> Iterator[int]:
        """Numbers of the index files that may hold the key."""
        return self._from(self.firsts, key)

    def find(self, key: str, k: int) -> Iterator[list]:
        """The captures of the key in the index file k, a block's at a time."""
        _, name, offset, length = self.files[k]
        if name not in self.directories:
            if len(self.directories) > 16:
                self.directories.clear()
            d = json.loads(self._read(name, offset, length))
            self.directories[name] = (d, [x[0] for x in d])
        d, firsts = self.directories[name]
        for b in self._from(firsts, key):
            if self.block[0] != (name, b):
                lines = [json.loads(x) for x in self._read(name, d[b][1], d[b][2]).decode().split("\n")]
                self.block = ((name, b), lines, [x[0] for x in lines])
            _, lines, keys = self.block
            yield lines[bisect.bisect_left(keys, key) : bisect.bisect_right(keys, key)]


def _places(folder: str, files):
    """A row for each key and index file that may hold it: the captures of one key may be in many files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(folder, files.value)
        for batch in batches:
            yield _rows([(k, key) for key in batch.column(0).to_pylist() for k in index.places(key)], "k long, key string")

    return run


def _find(folder: str, files):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(folder, files.value)
        for batch in batches:
            rows = []
            for k, key in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for found in index.find(key, k):
                    rows += map(tuple, found)
                    if len(rows) >= 10_000:
                        yield _rows(rows, CAPTURE)
                        rows = []
            if rows:
                yield _rows(rows, CAPTURE)

    return run


def _fetch(folder: str, with_payload: bool):
    """Records by their ranges; ranges that adjoin or nearly do are read at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_fs(folder)
        name, f, start, data = None, None, 0, b""
        for batch in batches:
            ranges = list(zip(*(batch.column(i).to_pylist() for i in (0, 1, 2)), strict=True))
            rows, held = [], 0
            for k, (file, offset, length) in enumerate(ranges):
                if file != name:
                    if f is not None:
                        f.close()
                    name, f, start, data = file, fs.open_input_file(f"{root}/{file}"), 0, b""
                if not start <= offset <= offset + length <= start + len(data):
                    end = offset + length
                    for other, o, n in ranges[k + 1 :]:
                        if other != file or o > end + 4096 or o + n - offset > READ_BYTES:
                            break
                        end = max(end, o + n)
                    start, data = offset, f.read_at(end - offset, offset)
                got = parse(gzip.decompress(data[offset - start : offset - start + length]))
                if not with_payload:
                    got["payload"] = None
                rows.append(tuple(got.values()))
                held += len(got["payload"] or b"")
                if held > READ_BYTES:
                    yield _rows(rows, RECORD)
                    rows, held = [], 0
            yield _rows(rows, RECORD)
        if f is not None:
            f.close()

    return run


class Archive:
    """Archives and index of pages, in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.files = spark, folder, []

    def write(self, pages: DataFrame, scratch: Scratch, least_bytes: int = 0, file_bytes: int = FILE_BYTES) -> DataFrame:
        """Writes a record for each row of pages (page_id, url, html) and the index; returns the captures.

        Of payloads of least_bytes or more that are equal, that of the smallest page_id
        is a response and the others revisit it; smaller ones are responses. A null html
        is an empty payload, a null url has the empty key. A null page_id is larger than
        all others. Rows that repeat the smallest page_id with its payload are responses
        too. A column other than these is not read."""
        ship(self.spark)
        html = F.coalesce(F.col("html"), F.lit(""))
        src = pages.select(F.col("page_id").cast("string").alias("page_id"), F.col("page_id").alias("_n"), "url", "html", base32_sha1(html).alias("digest"), F.sha2(html, 256).alias("same"), F.octet_length(html).alias("bytes"))
        big = src.where(F.col("bytes") >= least_bytes)
        # equality is that of SHA-256, as different payloads of one SHA-1 are known
        first = big.groupBy("same").agg(F.min("_n").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").select("same", "first")
        first = scratch.save(first, "firsts")  # written, so that the join deals both sides anew and a payload of many pages can be split
        # the few that revisit are found without their payloads
        again = big.select("_n", "same").join(first, "same").where("_n is null or _n <> first").select(F.col("_n").alias("_id"), F.col("same").alias("_d"), F.col("first").cast("string").alias("refers_to")).distinct()
        again = scratch.save(again, "revisits")
        rows = src.join(again, src["_n"].eqNullSafe(again["_id"]) & (src["same"] == again["_d"]), "left").select("page_id", "url", "html", "digest", "refers_to")
        captures = scratch.save(rows.mapInArrow(_write(f"{self.folder}/archive", file_bytes), CAPTURE), "captures")
        n = captures.count()
        parts = max(1, min(10_000, n // 20_000))
        ordered = captures.repartitionByRange(parts, "key", "page_id").sortWithinPartitions("key", "page_id")
        files = scratch.save(ordered.mapInArrow(_index(f"{self.folder}/index", BLOCK_LINES), FILES), "index-files")
        self.files = sorted(tuple(r) for r in files.collect())  # one for each index file
        return captures

    def lookup(self, urls: DataFrame, with_payload: bool = False) -> DataFrame:
        """The records of all captures of these urls (column url), each once."""
        ship(self.spark)
        keys = urls.select("url").distinct().mapInArrow(_keys, "key string").distinct()
        files, folder = self.spark.sparkContext.broadcast(self.files), f"{self.folder}/index"
        at = keys.mapInArrow(_places(folder, files), "k long, key string")
        at = at.repartition(max(1, min(10_000, len(self.files))), "k").sortWithinPartitions("k", "key")
        found = at.mapInArrow(_find(folder, files), CAPTURE)
        # ranges of one stretch of an archive go to one task, in order
        found = found.select("file", "offset", "length", F.floor(F.col("offset") / (8 << 20)).alias("stretch"))
        found = found.repartition("file", "stretch").sortWithinPartitions("file", "offset").select("file", "offset", "length")
        return found.mapInArrow(_fetch(f"{self.folder}/archive", with_payload), RECORD)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([url_key(u) for u in batch.column(0).to_pylist()], pa.string())], names=["key"])


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives of all pages, read back by looking up every page's url."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    scratch = Scratch(spark, "warc")
    archive = Archive(spark, scratch.path("store"))
    archive.write(pages, scratch)
    kind = pages.schema["page_id"].dataType.simpleString()
    got = archive.lookup(pages)
    return got.select(F.col("page_id").cast(kind), "url", "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind))


ORACLE = """
WITH p AS (
  SELECT page_id, url, coalesce(html, '') AS h FROM pages
), s AS (
  SELECT page_id, url, CAST(strlen(h) AS BIGINT) AS payload_bytes, min(page_id) OVER (PARTITION BY h) AS first, sha1(h) AS x FROM p
), d AS (
  SELECT *, [CAST('0x' || substr(x, 5 * k + 1, 5) AS INTEGER) FOR k IN range(0, 8)] AS v FROM s
)
SELECT page_id, url, payload_bytes,
  array_to_string([array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((n >> b) & 31), 1) FOR b IN [15, 10, 5, 0]], '') FOR n IN v], '') AS payload_digest,
  CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first = page_id THEN NULL ELSE first END AS refers_to
FROM d
"""
