"""WARC files: writing, and splitting them by boundary chains.

A file is read in ranges by independent tasks.  Each finds every occurrence
of the version line (in gzipped files: of a member's first bytes), also those
inside payloads, reads the header there and emits the offset with the offset of
the record that would follow.  Only what is reached from the file's start by
following these links is a record.  Pointer jumping first takes each candidate
of a range to where its chain leaves the range, then runs over the candidates
that such exits lead to: a file of any number of records is a few of them for
each range.
"""

from __future__ import annotations

import gzip
import posixpath
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from .common import filesystem, fresh_path, stored

#: Bytes of a range that one task step searches, and what is first read beyond it for a header.
RANGE, HEADER = 8 << 20, 64 << 10
_MAGIC = re.compile(rb"WARC/1\.[01]\r\n")
_GZIP = b"\x1f\x8b\x08"
_LENGTH = re.compile(rb"\r\ncontent-length:[ \t]*(\d+)[ \t]*(?=\r\n)", re.IGNORECASE)
_BLANK = b"\r\n\r\n"


def record(page_id: int | None, url: str | None, html: str | None) -> bytes:
    """One response record.  Nulls are marked by a header of their own; control characters and % of a URL are quoted."""
    body = (html or "").encode()
    head = ["WARC/1.0", "WARC-Type: response", "WARC-Date: 2024-01-01T00:00:00Z", "Content-Type: text/html; charset=utf-8"]
    head += [f"WARC-Record-ID: <urn:page:{page_id}>"] if page_id is not None else []
    head += [f"WARC-Target-URI: {quote(url, safe=''.join(map(chr, range(33, 127))).replace('%', ''))}"] if url is not None else []
    head += ["X-Null-Payload: 1"] if html is None else []
    return "\r\n".join([*head, f"Content-Length: {len(body)}", "", ""]).encode() + body + b"\r\n\r\n"


def write_warc(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", gzipped: bool = False) -> DataFrame:
    """Writes one file for each partition, each record a gzip member of its own with ``gzipped``; (path, size) of the files of the attempts that succeeded."""
    ship(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        fs.create_dir(root, recursive=True)
        name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc{'.gz' * gzipped}"  # a retried task writes another file
        size = 0
        with fs.open_output_stream(posixpath.join(root, name), compression=None) as out:
            for batch in batches:
                for row in zip(*(c.to_pylist() for c in batch.columns)):
                    data = record(*row)
                    if gzipped:
                        data = gzip.compress(data, 6, mtime=0)
                    out.write(data)
                    size += len(data)
        if size:
            yield pa.RecordBatch.from_arrays([pa.array([posixpath.join(folder, name)]), pa.array([size])], ["path", "size"])

    rows = pages.select(F.col(id_col).cast("bigint"), F.col(url_col).cast("string"), F.col(html_col).cast("string"))
    return rows.mapInArrow(run, "path string, size bigint")


def header_at(data: bytes, at: int) -> tuple[int, int] | None:
    """(end of the header, length of the payload), or None if it isn't a whole header with one length."""
    end = data.find(_BLANK, at)
    found = [m[1] for m in _LENGTH.finditer(data, at, end + 2)] if end >= 0 else []
    return (end + 4, int(found[0])) if len(found) == 1 and len(found[0]) < 19 else None


def _plain_candidates(f: pa.NativeFile, size: int, start: int) -> Iterator[tuple[int, int]]:
    """(offset, offset of the record that would follow) of the version lines of a range.

    What lies between a version line and the next blank line is read in growing steps, whatever its length: no more than
    a record, which is a row later on.
    """
    data = f.read_at(min(RANGE + HEADER, size - start), start)
    magics = [m.start() for m in _MAGIC.finditer(data, 0, min(RANGE + 16, len(data)))]
    end, lengths, k, step = -1, [], 0, HEADER
    for at in magics:
        if at >= RANGE:
            break
        if end < at:
            searched = at
            while (end := data.find(_BLANK, searched)) < 0 and start + len(data) < size:
                searched = max(at, len(data) - 3)
                data += f.read_at(min(step, size - start - len(data)), start + len(data))
                step *= 2
            if end < 0:
                break  # no blank line follows, for the later ones neither
            lengths, k = [(m.start(), m[1]) for m in _LENGTH.finditer(data, at, end + 2)], 0
        while k < len(lengths) and lengths[k][0] < at:
            k += 1
        if k == len(lengths) - 1 and len(lengths[k][1]) < 19:
            yield start + at, start + end + 4 + int(lengths[k][1]) + 4


def _gzip_candidates(f: pa.NativeFile, size: int, start: int) -> Iterator[tuple[int, int]]:
    """(offset, offset behind the member) of what can be unpacked as a gzip member from the range on."""
    data = f.read_at(min(RANGE + len(_GZIP) - 1, size - start), start)
    view, at = memoryview(data), data.find(_GZIP)
    while at >= 0:
        member, pos, chunk = zlib.decompressobj(31), start + at, view[at:]
        try:
            while chunk and not member.eof:
                pos += len(chunk)
                for s in range(0, len(chunk), HEADER):  # what a step unpacks is dropped at once
                    rest = member.decompress(chunk[s : s + HEADER], HEADER)
                    while not member.eof and (member.unconsumed_tail or rest):
                        rest = member.decompress(member.unconsumed_tail, HEADER)
                    if member.eof:
                        pos -= len(member.unused_data) + len(chunk[s + HEADER :])
                        break
                if not member.eof:
                    chunk = f.read_at(min(HEADER, size - pos), pos) if pos < size else b""
            if member.eof:
                yield start + at, pos
        except zlib.error:
            pass
        at = data.find(_GZIP, at + 1)


def _exits(at: np.ndarray, following: np.ndarray) -> np.ndarray:
    """For each candidate (in order of the offsets) where its chain leaves the candidates, by pointer jumping."""
    n = len(at)
    to = np.searchsorted(at, following)
    to = np.where((to < n) & (at[np.minimum(to, n - 1)] == following), to, np.arange(n))
    while (to[to] != to).any():
        to = to[to]
    return following[to]


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each range: its candidates, what follows them and where their chains leave the range."""
    for batch in batches:
        for path, size, start in zip(*(c.to_pylist() for c in batch.columns)):
            fs, name = filesystem(path)
            with fs.open_input_file(name) as f:
                packed = f.read_at(min(len(_GZIP), size), 0) == _GZIP
                pairs = [(a, b) for a, b in (_gzip_candidates if packed else _plain_candidates)(f, size, start) if b <= size]
            if pairs:
                at, following = np.array(pairs, np.int64).T
                lists = [pa.array([x], pa.list_(pa.int64())) for x in (at, following, _exits(at, following))]
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([start], pa.int64()), *lists], ["path", "start", "at", "next", "exit"])


def chain(at: np.ndarray, following: np.ndarray) -> np.ndarray:
    """Which of the candidates (in order of their offsets) the chain from offset 0 reaches, by pointer jumping."""
    n = len(at)
    if not n or at[0] != 0:
        return np.zeros(n, bool)
    to = np.searchsorted(at, following)
    to = np.where((to < n) & (at[np.minimum(to, n - 1)] == following), to, n)
    jump, reached = np.append(to, n), np.zeros(n + 1, bool)
    reached[0] = True
    while True:
        more = reached.copy()
        more[jump[np.flatnonzero(reached)]] = True
        if (more == reached)[:n].all():
            return reached[:n]
        reached, jump = more, jump[jump]


def _chains(table: pa.Table) -> pa.Table:
    order = np.argsort(table.column("at").to_numpy(), kind="stable")
    table = table.take(pa.array(order))
    return table.filter(pa.array(chain(table.column("at").to_numpy(), table.column("exit").to_numpy()))).select(["path", "at"])


def _field(head: bytes, name: str) -> str | None:
    found = re.search(rb"\r\n" + name.encode() + rb":[ \t]*(.*?)[ \t]*\r\n", head, re.IGNORECASE)
    return found[1].decode("utf-8", "replace") if found else None


def _parsed(data: bytes) -> Iterator[tuple[int | None, str | None, str | None]]:
    """Rows of the records that lie end to end in data."""
    pos = 0
    while pos < len(data) and _MAGIC.match(data, pos):
        got = header_at(data, pos)
        if got is None or got[0] + got[1] > len(data):
            return
        head, body = data[pos : got[0]], data[got[0] : got[0] + got[1]]
        page, url = _field(head, "WARC-Record-ID"), _field(head, "WARC-Target-URI")
        key = re.fullmatch(r"<urn:page:(-?\d+)>", page or "")
        yield int(key[1]) if key else None, None if url is None else unquote(url), None if _field(head, "X-Null-Payload") else body.decode("utf-8", "replace")
        pos = got[0] + got[1] + 4


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The records of each range from where the file's chain enters it."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("html", pa.string())])
    pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
    for batch in batches:
        for k, (path, entry) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
            at, following = (np.asarray(batch.column(c)[k].values) for c in (2, 3))
            at, following = at[np.searchsorted(at, entry) :], following[np.searchsorted(at, entry) :]
            spans = np.stack([at, following], axis=1)[_walk(at, following)].tolist()
            fs, name = filesystem(path)
            with fs.open_input_file(name) as f:
                packed = f.read_at(len(_GZIP), 0) == _GZIP
                rows, held, block, origin = [], 0, b"", 0
                for a, b in spans:
                    if b > origin + len(block):  # records that follow each other are read together
                        origin, block = a, f.read_at(max(b, min(a + RANGE, spans[-1][1])) - a, a)
                    data = block[a - origin : b - origin]
                    for row in _parsed(gzip.decompress(data) if packed else data):
                        rows.append(row)
                        held += len(row[2] or "")
                    if held > 4 << 20:
                        yield pack(rows)
                        rows, held = [], 0
            if rows:
                yield pack(rows)


def _walk(at: np.ndarray, following: np.ndarray) -> np.ndarray:
    """Which of the candidates the chain from the first one reaches."""
    return chain(at - at[0], following - at[0]) if len(at) else np.zeros(0, bool)


def read_warc(spark: SparkSession, files: DataFrame) -> DataFrame:
    """(page_id, url, html) of the records of the files (path, size), each a chain of records or of gzip members of records.

    What follows a broken record in a file can't be told from payload and is left out; a file that doesn't begin with
    a record gives none; a record whose payload is cut off by the file's end is left out.  A header may have any length; one
    with no length, several, or a length of 19 digits or more begins no record.  Null paths and sizes, and empty files give
    no rows, as no files do; a file that is named twice is read once.  A record is a row, so it must fit into memory.
    """
    ship(spark)
    files = stored(files.select("path", "size").where("path is not null and size > 0").distinct(), "warc-files")
    total = files.agg(F.sum("size")).first()[0] or 0
    tasks = max(1, min(10_000, -(-total // RANGE)))
    ranges = files.select("path", "size", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("size") - 1, F.lit(RANGE).cast("bigint"))).alias("start")).repartition(tasks, "path", "start")
    found = stored(ranges.mapInArrow(_candidates, "path string, start bigint, at array<bigint>, next array<bigint>, exit array<bigint>"), "warc-candidates")
    links = found.select("path", F.inline(F.arrays_zip("at", "exit")))
    targets = links.select("path", F.col("exit").alias("at")).unionAll(files.select("path", F.lit(0).cast("bigint").alias("at"))).distinct()
    entered = links.join(targets, ["path", "at"], "left_semi")  # a few for each range
    real = entered.groupBy("path").applyInArrow(_chains, "path string, at bigint")
    real = stored(real.select("path", F.expr(f"at div {RANGE} * {RANGE}").alias("start"), F.col("at").alias("entry")), "warc-entries")
    placed = found.join(real, ["path", "start"]).select("path", "entry", "at", "next").repartition(tasks, "path", "entry")
    return placed.mapInArrow(_records, "page_id bigint, url string, html string")


def round_trip(pages: DataFrame, **columns: str | bool) -> DataFrame:
    """Writes pages as WARC files into the shared folder and reads them back: the same page_id, url and html in some order.

    Nulls in any column, empty pages, repeated rows, URLs and pages of any length and payloads that hold whole WARC records come back
    as they were; other columns are left out.  Lone surrogates don't occur in Spark's strings.
    """
    spark = pages.sparkSession
    files = stored(write_warc(pages, fresh_path(spark, "warc"), **columns), "warc-written")
    return read_warc(spark, files)
