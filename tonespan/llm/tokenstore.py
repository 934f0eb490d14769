"""Token ids as raw binary shards with a minimal perfect hash index.

Tasks encode their rows and write shards of little-endian ids where they are;
payloads never move.  Only (key, shard, offset, length) is shuffled, into
index parts by a hash of the key.  Each part holds a minimal perfect hash
function (levels of bits, a key belongs to the first level where it met no
other), and arrays of fingerprints, shards, offsets and lengths in its order.

With positions, rows are first range-partitioned and sorted by them, so that
shards, in order of their numbers, hold the documents in training order.

:func:`save` writes the shards as raw files and the index parts as files in which
a look-up is a few reads at known places; :class:`Reader` and :func:`lookup` use these.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from collections import OrderedDict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..session import ship
from . import kernels as K
from .common import filesystem, stored
from .pretoken import TOKENIZER, pretokens, share_ranks, worker_cache

#: Ids in a shard before it is closed, keys in an index part on average, bits of a level for each key in it.
SHARD_IDS, PART_KEYS, GAMMA = 1 << 20, 1 << 19, 2.0
_SEED = np.uint64(0xA0761D6478BD642F)
_PAYLOAD = "kind string, shard bigint, n_docs bigint, n_tokens bigint, id_bytes int, doc_ids array<bigint>, positions array<double>, starts array<bigint>, payload binary"
_INDEX = "kind string, part bigint, parts bigint, n_docs bigint, levels array<bigint>, bits binary, fingerprints binary, shards binary, offsets binary, lengths binary"


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    return (K.mix64(keys.astype(np.int64).view(np.uint64) ^ _SEED) % np.uint64(parts)).astype(np.int64)


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return (K.mix64(keys.astype(np.int64).view(np.uint64) * np.uint64(0xE7037ED1A0B428DB) + np.uint64(1)) >> np.uint64(32)).astype(np.uint32)


def _spot(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    return (K.mix64(keys + np.uint64((level + 1) * int(_SEED) % 2**64)) % np.uint64(size)).astype(np.int64)


def build_mph(keys: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Sizes of the levels, all levels' bits, and the slot (0..n-1) of each of the distinct keys."""
    keys = keys.astype(np.int64).view(np.uint64)
    sizes, bits, at, where = [], [], np.arange(len(keys)), np.zeros(len(keys), np.int64)
    base = 0
    while len(at):
        size = max(64, int(GAMMA * len(at)) + 1)
        spot = _spot(keys[at], len(sizes), size)
        alone = np.bincount(spot, minlength=size) == 1
        mine = alone[spot]
        where[at[mine]] = base + spot[mine]
        sizes.append(size)
        bits.append(alone)
        base += size
        at = at[~mine]
    flat = np.concatenate(bits) if bits else np.zeros(0, bool)
    rank = np.cumsum(flat) - 1
    return sizes, flat, rank[where] if len(keys) else where


class TokenStore:
    """Keyed access to collected rows of :func:`token_store`."""

    def __init__(self, rows: Iterable[Row]) -> None:
        self.shards, self.parts, self.n_parts = {}, {}, 0
        for r in rows:
            if r.kind == "payload":
                self.shards[r.shard] = np.frombuffer(r.payload, f"<u{r.id_bytes}")
            else:
                self.n_parts = r.parts
                flat = np.unpackbits(np.frombuffer(r.bits, np.uint8), bitorder="little")[: sum(r.levels)].astype(bool)
                self.parts[r.part] = (r.levels, flat, np.cumsum(flat) - 1, *(np.frombuffer(getattr(r, c), t) for c, t in (("fingerprints", "<u4"), ("shards", "<i8"), ("offsets", "<i8"), ("lengths", "<i8"))))

    def get(self, key: int) -> np.ndarray | None:
        """The ids of a document, or None; the time doesn't depend on the number of keys (a strange key passes with 2**-32)."""
        k = np.array([key], np.int64)
        part = self.parts.get(int(part_of(k, self.n_parts)[0])) if self.parts else None
        if part is None:
            return None
        levels, flat, rank, prints, shards, offsets, lengths = part
        base = 0
        for level, size in enumerate(levels):
            spot = base + int(_spot(k.view(np.uint64), level, size)[0])
            if flat[spot]:
                slot = rank[spot]
                if prints[slot] != fingerprint(k)[0]:
                    return None
                return self.shards[shards[slot]][offsets[slot] : offsets[slot] + lengths[slot]]
            base += size
        return None


def token_store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, shard_ids: int = SHARD_IDS, part_keys: int = PART_KEYS, position_col: str | None = None) -> DataFrame:
    """Rows of kind 'payload' (shards with their documents' ids and starts) and of kind 'index' (parts of the hash index).

    Keys are integer ids.  A null text is stored as no ids, like an empty one.  Rows with a null id are in the payload
    (as document null) but have no key; of rows that repeat an id the key leads to the first (least shard and offset).
    An empty table gives no rows.  A document's ids always stay in one shard, however long it is.  Other columns aren't read.
    With ``position_col`` documents are stored in its order (nulls first, ties by id), and shards have their positions.
    """
    spark = docs.sparkSession
    ship(spark)
    ranks = share_ranks(spark, tokenizer)

    @K.tidy
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, task, seq = worker_cache(ranks.value, tokenizer, True), TaskContext.get().partitionId(), 0
        keys: list = []
        places: list = []
        sizes: list[np.ndarray] = []
        ids: list[np.ndarray] = []

        def close() -> pa.RecordBatch:
            n = np.concatenate(sizes)
            starts = np.concatenate([[0], np.cumsum(n)])
            data = np.concatenate(ids)
            row = [["payload"], [(task << 24) + seq], [len(n)], [int(starts[-1])], [data.itemsize], [keys], [places if position_col else None], [starts.tolist()], [data.astype(data.dtype.newbyteorder("<")).tobytes()]]
            types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types)], ["kind", "shard", "n_docs", "n_tokens", "id_bytes", "doc_ids", "positions", "starts", "payload"])

        for batch in batches:
            for a, b in K.text_chunks(batch.column(1)):
                joined, starts, ends, hashes, offs = pretokens(batch.column(1).slice(a, b - a))
                flat, size = cache.ids(joined, starts, ends, hashes)
                ids.append(flat)
                sizes.append(np.diff(np.concatenate([[0], np.cumsum(size)])[offs]))
                keys += batch.column(0).slice(a, b - a).to_pylist()
                places += batch.column(2).slice(a, b - a).to_pylist()
                if sum(map(len, ids)) >= shard_ids:
                    yield close()
                    seq += 1
                    keys, places, sizes, ids = [], [], [], []
        if keys:
            yield close()

    place = F.col(position_col).cast("double") if position_col else F.lit(None).cast("double")
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"), place.alias("position"))
    if position_col:
        rows = rows.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id")
    payload = stored(rows.mapInArrow(write, _PAYLOAD), "payload")
    total = payload.agg(F.sum("n_docs")).first()[0] or 0
    parts = max(1, -(-total // part_keys))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids = batch.column(1)[k].values
                starts = np.asarray(batch.column(2)[k].values)
                keys = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                shard = np.full(len(keys), batch.column(0)[k].as_py())
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (part_of(keys, parts), keys, shard, starts[:-1], np.diff(starts))], ["part", "key", "shard", "start", "size"]).filter(ids.is_valid())

    def index(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        keys, shard, start, size = (table.column(c).to_numpy() for c in ("key", "shard", "start", "size"))
        order = np.lexsort((start, shard, keys))
        order = order[np.concatenate([[True], np.diff(keys[order]) != 0])]
        keys = keys[order]
        levels, flat, slot = build_mph(keys)
        out = {}
        for name, values, kind in (("fingerprints", fingerprint(keys), "<u4"), ("shards", shard[order], "<i8"), ("offsets", start[order], "<i8"), ("lengths", size[order], "<i8")):
            there = np.zeros(len(keys), kind)
            there[slot] = values
            out[name] = there.tobytes()
        row = {"kind": "index", "part": part, "parts": parts, "n_docs": len(keys), "levels": levels, "bits": np.packbits(flat, bitorder="little").tobytes(), **out}
        types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), *[pa.binary()] * 5]
        return pa.table({k: pa.array([v], t) for (k, v), t in zip(row.items(), types)})

    located = payload.select("shard", "doc_ids", "starts").mapInArrow(place, "part bigint, key bigint, shard bigint, start bigint, size bigint")
    return payload.unionByName(located.groupBy("part").applyInArrow(index, _INDEX), allowMissingColumns=True)


_BLOCK, _RECORD = 512, np.dtype([("print", "<u4"), ("shard", "<i8"), ("offset", "<i8"), ("length", "<i8")])


def index_file(row: dict) -> bytes:
    """An index part as a file: number and sizes of the levels, blocks of 512 bits with the rank before them, a record for each slot."""
    bits = np.frombuffer(row["bits"], np.uint8)
    bits = np.concatenate([bits, np.zeros(-len(bits) % (_BLOCK // 8), np.uint8)]).reshape(-1, _BLOCK // 8)
    ones = np.unpackbits(bits, axis=1).sum(axis=1, dtype=np.int64)
    blocks = np.zeros(len(bits), [("rank", "<i8"), ("bits", "u1", _BLOCK // 8)])
    blocks["rank"], blocks["bits"] = np.cumsum(ones) - ones, bits
    records = np.zeros(row["n_docs"], _RECORD)
    for name, column in (("print", "fingerprints"), ("shard", "shards"), ("offset", "offsets"), ("length", "lengths")):
        records[name] = np.frombuffer(row[column], _RECORD[name])
    return np.array([len(row["levels"]), *row["levels"]], "<i8").tobytes() + blocks.tobytes() + records.tobytes()


def save(store: DataFrame, folder: str) -> None:
    """Writes the rows of :func:`token_store`, where they are, as raw files below ``folder``: one for each shard and index part.

    A file gets its name when it is whole, so tasks may be run again.  The last file, meta.json, says that all are there.
    """
    spark = store.sparkSession
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                name, data = (f"{row['shard']}.ids", row["payload"]) if row["kind"] == "payload" else (f"{row['part']}.mph", index_file(row))
                part = posixpath.join(root, f".{uuid.uuid4().hex}")
                with fs.open_output_stream(part) as out:
                    out.write(data)
                fs.move(part, posixpath.join(root, name))
                yield pa.RecordBatch.from_arrays([pa.array([row["parts"]], pa.int64()), pa.array([row["id_bytes"]], pa.int64())], ["parts", "id_bytes"])

    fs, root = filesystem(folder)
    fs.create_dir(root, recursive=True)
    keep = ["kind", "shard", "id_bytes", "payload", "part", "parts", "n_docs", "levels", "bits", "fingerprints", "shards", "offsets", "lengths"]
    done = store.select(*keep).mapInArrow(run, "parts bigint, id_bytes bigint").agg(F.max("parts").alias("parts"), F.max("id_bytes").alias("id_bytes")).first()
    with fs.open_output_stream(posixpath.join(root, "meta.json")) as out:
        out.write(json.dumps({"parts": done.parts or 0, "id_bytes": done.id_bytes or 2}).encode())


class Reader:
    """Keyed access to the files of :func:`save`.  A look-up reads one block of bits a level (1.6 on average), one record and the ids; files stay open."""

    def __init__(self, folder: str, most_open: int = 256) -> None:
        self.fs, self.root = filesystem(folder)
        with self.fs.open_input_file(posixpath.join(self.root, "meta.json")) as f:
            meta = json.loads(f.read())
        self.parts, self.kind, self.most, self.files = meta["parts"], f"<u{meta['id_bytes']}", most_open, OrderedDict()

    def _file(self, name: str) -> pa.NativeFile:
        if name not in self.files:
            if len(self.files) >= self.most:
                self.files.popitem(last=False)[1].close()
            self.files[name] = self.fs.open_input_file(posixpath.join(self.root, name))
        self.files.move_to_end(name)
        return self.files[name]

    def place(self, key: int) -> tuple[int, int, int] | None:
        """(shard, offset, length) of a key, or None (a strange key passes with 2**-32)."""
        k = np.array([key], np.int64)
        try:
            f = self._file(f"{int(part_of(k, self.parts)[0])}.mph") if self.parts else None
        except FileNotFoundError:  # a part that no key fell into
            f = None
        if f is None:
            return None
        levels = np.frombuffer(f.read_at(8 * (1 + int(np.frombuffer(f.read_at(8, 0), "<i8")[0])), 0), "<i8")[1:]
        first, base = 8 * (1 + len(levels)), 0
        for level, size in enumerate(levels.tolist()):
            spot = base + int(_spot(k.view(np.uint64), level, size)[0])
            block = f.read_at(8 + _BLOCK // 8, first + spot // _BLOCK * (8 + _BLOCK // 8))
            bits = np.unpackbits(np.frombuffer(block, np.uint8, offset=8), bitorder="little")
            if bits[spot % _BLOCK]:
                slot = int(np.frombuffer(block, "<i8", 1)[0]) + int(bits[: spot % _BLOCK].sum())
                blocks = -(-int(levels.sum()) // _BLOCK)
                got = np.frombuffer(f.read_at(_RECORD.itemsize, first + blocks * (8 + _BLOCK // 8) + slot * _RECORD.itemsize), _RECORD)[0]
                return (int(got["shard"]), int(got["offset"]), int(got["length"])) if got["print"] == fingerprint(k)[0] else None
            base += size
        return None

    def get(self, key: int) -> np.ndarray | None:
        """The ids of a document, or None."""
        at = self.place(key)
        if at is None:
            return None
        width = int(self.kind[2:])
        return np.frombuffer(self._file(f"{at[0]}.ids").read_at(at[2] * width, at[1] * width), self.kind)


def lookup(keys: DataFrame, folder: str, key_col: str = "doc_id") -> DataFrame:
    """(key, ids) for every row of keys, ids null where the store has no such key; each task reads what its keys need, no more."""
    spark = keys.sparkSession
    ship(spark)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(folder)
        for batch in batches:
            got = [None if k is None else reader.get(k) for k in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if g is None else g.astype(np.int64) for g in got], pa.list_(pa.int64()))], ["key", "ids"])

    rows = keys.select(F.col(key_col).cast("bigint").alias("key"))
    return rows.mapInArrow(run, "key bigint, ids array<bigint>")
