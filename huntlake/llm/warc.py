"""Operator 3: WARC archives with a two-level capture index.

Map tasks write gzip-per-record WARC/1.1 files in the shared folder and report where
each record stands. The captures are sorted by reversed-host URL key (range
partitions), packed into compressed blocks, and every index file ends in a sparse
directory of its blocks. A lookup finds the index file in the list of their first keys
(one row a file), the block by binary search in that file's directory, the capture by
binary search in the block, and then reads the record's byte range from its archive.

A task that is retried writes new files under new names; only the files of the attempt
that reported are ever looked at, because reports are checkpointed before use.

Defined results: null html is an empty payload; payloads under ``least`` bytes are never
revisits. Of equal payloads the record with the largest page_id is the response and
rows that share that page_id all are; a record without page_id is always a response and
never revisited. A null or odd url has a key all the same (white space and control
characters are escaped in it, those outside printable ASCII in the header). Rows that share id and url are
one lookup that finds them all. Empty tables are fine. Other columns are not read.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import re
import struct
import uuid
import zlib
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from huntlake.session import cut_lineage, scratch_path

LEAST, BLOCK_ENTRIES, ARCHIVE_BYTES = 1000, 512, 1 << 28
SALTS, SMALL_ROWS = 16, 200_000
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _store(path: str) -> tuple[fs.FileSystem, str]:
    path = re.sub(r"^file:/+", "file:///", path)
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def surt(url):
    """Reversed-host key of a URL column: com,example,www)/path?query; A-Z of the host lower-cased, white space and control characters escaped."""
    text = F.coalesce(url, F.lit(""))
    host = F.lower(F.regexp_extract(text, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rest = F.regexp_replace(text, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*", "")
    whole = F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest)
    return F.regexp_replace(whole, r"[\x00-\x20\x7f]", "%20")  # index entries are lines of columns


def _capture_key(page_id, url):
    return F.concat(surt(url), F.lit(" "), F.coalesce(page_id.cast("string"), F.lit("")))


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record as a gzip member. A revisit has no payload but tells its length."""
    def urn(x):
        return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{x}')}>"

    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http + (payload if refers_to is None else b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {urn(page_id)}", f"WARC-Date: {DATE}",
            f"WARC-Target-URI: {quote(url or 'about:blank', safe=''.join(map(chr, range(33, 127))))}", f"WARC-Payload-Digest: sha1:{digest}",
            "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}", f"Page-Id: {'' if page_id is None else page_id}", f"Payload-Length: {len(payload)}"]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {urn(refers_to)}", f"Refers-To-Page-Id: {refers_to}"]
    pack = zlib.compressobj(3, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n") + pack.flush()


def parse_record(member: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, payload) of a gzip member."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    headers = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    return headers, rest[:int(headers["Content-Length"])].partition(b"\r\n\r\n")[2]


def write_archives(pages: DataFrame, base: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST) -> DataFrame:
    """Writes the records of all pages and returns their captures: (key, file, offset, length)."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), html.alias("html"), F.sha1(html.cast("binary")).alias("digest"))
    slim = rows.where(F.octet_length("html") >= least).select("page_id", "digest")
    best = slim.groupBy("digest").agg(F.max("page_id").alias("response"), F.min("page_id").alias("low")).where("low < response")
    salted = best.select("digest", "response", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))  # a page copied everywhere is not one key
    revisits = cut_lineage(slim.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")).join(salted, ["digest", "salt"])
                           .where("page_id < response").select("page_id", "digest", "response").distinct())
    if revisits.count() <= SMALL_ROWS:  # about a hundred bytes each; the pages then stay where they are
        revisits = F.broadcast(revisits)
    ready = rows.join(revisits, ["page_id", "digest"], "left").select("page_id", "url", "html", "digest", "response", _capture_key(F.col("page_id"), F.col("url")).alias("key"))

    def write(batches):
        store, folder = _store(base)
        store.create_dir(folder, recursive=True)
        out, name, at = None, "", 0
        for batch in batches:
            files, offsets, lengths = [], [], []
            for row in zip(*batch.columns[:5]):
                page_id, url, text, digest, response = (x.as_py() for x in row)
                if out is None or at >= ARCHIVE_BYTES:
                    if out:
                        out.close()
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(f"{folder}/{name}", compression=None)
                member = record_bytes(page_id, url, text.encode(), digest, response)
                out.write(member)
                files.append(name)
                offsets.append(at)
                lengths.append(len(member))
                at += len(member)
            yield pa.RecordBatch.from_arrays([batch.column(5), pa.array(files, pa.string()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())], ["key", "file", "offset", "length"])
        if out:
            out.close()

    return cut_lineage(ready.mapInArrow(write, "key string, file string, offset long, length long"))


def write_index(captures: DataFrame, base: str, block_entries: int = BLOCK_ENTRIES) -> list[tuple[str, str]]:
    """Sorted captures in compressed blocks; returns (first key, index file) of each index file, at most one a partition."""

    def write(batches):
        store, folder = _store(base)
        out, name, at, directory, entries = None, f"{uuid.uuid4().hex}.idx", 0, [], []

        def flush():
            nonlocal at
            block = zlib.compress("\n".join("\t".join(map(str, e)) for e in entries).encode())
            out.write(block)
            directory.append([entries[0][0], at, len(block)])
            at += len(block)
            entries.clear()

        for batch in batches:
            for entry in zip(*[c.to_pylist() for c in batch.columns]):
                if out is None:
                    store.create_dir(folder, recursive=True)
                    out = store.open_output_stream(f"{folder}/{name}", compression=None)
                entries.append(entry)
                if len(entries) >= block_entries:
                    flush()
        if out:
            if entries:
                flush()
            tail = zlib.compress(json.dumps(directory).encode())
            out.write(tail + struct.pack("<Q", len(tail)))
            out.close()
            yield pa.RecordBatch.from_pydict({"first": [directory[0][0]], "file": [name]})

    n = int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = captures.repartitionByRange(n, "key", "file", "offset").sortWithinPartitions("key", "file", "offset")
    return sorted((r["first"], r["file"]) for r in ranged.mapInArrow(write, "first string, file string").collect())


class _IndexFile:
    """An open index file: its directory, and the block read last."""

    def __init__(self, store: fs.FileSystem, path: str):
        self.file = store.open_input_file(path)
        size = self.file.size()
        (tail,) = struct.unpack("<Q", self.file.read_at(8, size - 8))
        self.directory = json.loads(zlib.decompress(self.file.read_at(tail, size - 8 - tail)))
        self.firsts = [d[0] for d in self.directory]
        self.block: tuple[int, list[list[str]], list[str]] = (-1, [], [])

    def entries(self, k: int) -> tuple[list[list[str]], list[str]]:
        if self.block[0] != k:
            _, offset, length = self.directory[k]
            rows = [line.split("\t") for line in zlib.decompress(self.file.read_at(length, offset)).decode().split("\n")]
            self.block = (k, rows, [r[0] for r in rows])
        return self.block[1:]

    def find(self, key: str):
        """All entries of the key, which may run over several blocks."""
        k = max(bisect.bisect_left(self.firsts, key) - 1, 0)
        while k < len(self.directory) and self.firsts[k] <= key:
            rows, keys = self.entries(k)
            yield from rows[bisect.bisect_left(keys, key):bisect.bisect_right(keys, key)]
            k += 1


def lookup(keys: DataFrame, top: list[tuple[str, str]], base: str) -> DataFrame:
    """(file, offset, length) of every capture whose key is in ``keys`` (a column ``key`` without repeats)."""

    def find(batches):
        store, folder = _store(base)
        firsts, opened, last = [t[0] for t in top], None, -1
        for batch in batches:
            out = []
            for key in batch.column(0).to_pylist():
                k = max(bisect.bisect_left(firsts, key) - 1, 0)
                while k < len(top) and firsts[k] <= key:  # a key's captures may run over several files
                    if k != last:
                        if opened:
                            opened.file.close()
                        opened, last = _IndexFile(store, f"{folder}/{top[k][1]}"), k
                    out += [(f, int(o), int(n)) for _, f, o, n in opened.find(key)]
                    k += 1
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["file", "offset", "length"])
        if opened:
            opened.file.close()

    n = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return keys.select("key").repartitionByRange(n, "key").sortWithinPartitions("key").mapInArrow(find, "file string, offset long, length long")


def read_records(places: DataFrame, base: str) -> DataFrame:
    """Reads the byte ranges and returns what the records say; a response's digest and length are taken from its payload."""

    def read(batches):
        store, folder = _store(base)
        name, source = None, None
        for batch in batches:
            out = []
            for file, offset, length in zip(*[c.to_pylist() for c in batch.columns]):
                if file != name:
                    if source:
                        source.close()
                    name, source = file, store.open_input_file(f"{folder}/{file}")
                headers, payload = parse_record(source.read_at(length, offset))
                page = int(headers["Page-Id"]) if headers["Page-Id"] else None
                if headers["WARC-Type"] == "response":
                    out.append((page, len(payload), hashlib.sha1(payload).hexdigest(), "response", None))
                else:
                    out.append((page, int(headers["Payload-Length"]), headers["WARC-Payload-Digest"].removeprefix("sha1:"), "revisit", int(headers["Refers-To-Page-Id"])))
            types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(types)], [x.split()[0] for x in RECORD.split(", ")])
        if source:
            source.close()

    n = int(places.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut_lineage(places).repartitionByRange(n, "file", "offset").sortWithinPartitions("file", "offset").mapInArrow(read, RECORD)


def archive_round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes all pages to archives, indexes them, looks every page up and reads its record back."""
    base = scratch_path(pages.sparkSession, "warc")
    top = write_index(write_archives(pages, base, id_col, url_col, html_col), base)
    keys = pages.select(_capture_key(F.col(id_col).cast("long"), F.col(url_col).cast("string")).alias("key")).distinct()
    return read_records(lookup(keys, top, base), base)
