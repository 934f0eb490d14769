"""Token counts by two map-side look-ups.

A first pass lets every task report its most frequent pre-tokens; the most
frequent of these get their lengths from the tokenizer once, in a compact
hash table that is broadcast.  The second pass sums lengths from that table;
what it lacks is encoded in the worker and kept in the worker's cache.
Neither pass shuffles the pre-tokens of the texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from . import kernels as K
from .pretoken import TOKENIZER, encoder, load_ranks, pretokens, share_ranks, worker_cache

#: Pre-tokens that a task reports, pre-tokens in the broadcast table, slots of the table (a power of two). All are fixed.
REPORT, FREQUENT, SLOTS = 4096, 1 << 16, 1 << 18


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The task's most frequent pre-tokens with their counts (rare ones are forgotten on the way, which can only cost speed)."""
    keys, counts, pieces = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, object)
    for batch in batches:
        for a, b in K.text_chunks(batch.column(0)):
            joined, starts, ends, hashes, _ = pretokens(batch.column(0).slice(a, b - a))
            new, at, n = np.unique(hashes, return_index=True, return_counts=True)
            top = np.argsort(-n, kind="stable")[: 2 * REPORT]
            text = np.array([joined[x:y] for x, y in zip(starts[at[top]].tolist(), ends[at[top]].tolist())] or [""], object)[: len(top)]
            both, first, inverse = np.unique(np.concatenate([keys, new[top]]), return_index=True, return_inverse=True)
            total = np.bincount(inverse, np.concatenate([counts, n[top]]), len(both)).astype(np.int64)
            best = np.argsort(-total, kind="stable")[: 4 * REPORT]
            keys, counts, pieces = both[best], total[best], np.concatenate([pieces, text])[first[best]]
    best = np.argsort(-counts, kind="stable")[:REPORT]
    yield pa.RecordBatch.from_arrays([pa.array(pieces[best].tolist(), pa.string()), pa.array(counts[best])], ["piece", "n"])


def frequent_table(texts: DataFrame, tokenizer: str = TOKENIZER) -> tuple[np.ndarray, np.ndarray]:
    """(keys, lengths) of SLOTS slots; of pre-tokens that meet in a slot the more frequent one has it."""
    ship(texts.sparkSession)
    top = texts.mapInArrow(_report, "piece string, n bigint").groupBy("piece").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "piece").limit(FREQUENT).select("piece").toArrow()
    pieces = top.column(0).combine_chunks()
    keys, lengths = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.uint16)
    if len(pieces):
        encode = encoder(load_ranks(tokenizer))._encode_single_piece
        # each piece is a text of its own here; a piece that falls apart when alone is left to the workers
        _, starts, _, hashes, docs = pretokens(pieces)
        for k in np.flatnonzero(np.diff(docs) == 1):
            slot = int(hashes[docs[k]]) & (SLOTS - 1)
            n = len(encode(pieces[int(k)].as_py()))
            if not keys[slot] and n < 1 << 16:
                keys[slot], lengths[slot] = hashes[docs[k]], n
    return keys, lengths


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, n_tokens) for every row, as the tokenizer's ordinary encoding counts them.

    A null text counts as 0, as an empty one does; null and repeated ids get a row each; other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    table = spark.sparkContext.broadcast(frequent_table(rows.where("text is not null").select("text"), tokenizer))
    ranks = share_ranks(spark, tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = worker_cache(ranks.value, tokenizer, False)
        for batch in batches:
            out = [np.zeros(0, np.int64)]
            for a, b in K.text_chunks(batch.column(1)):
                joined, starts, ends, hashes, offs = pretokens(batch.column(1).slice(a, b - a))
                total = np.concatenate([[0], np.cumsum(cache.lengths(joined, starts, ends, hashes, table.value))])
                out.append(np.diff(total[offs]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(out))], ["doc_id", "n_tokens"])

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, n_tokens bigint")
