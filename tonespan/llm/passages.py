"""Passages that repeat across documents, found with seeds that no such passage lacks.

For a hash function, the Cartesian tree over the hashes of a document's tokens
(word 5-grams) has a node for each token, whose span is the largest stretch in
which that token has the least hash.  The tokens with spans of at least
``SPACING`` are the seeds, about 2n/SPACING; windows around them are grouped by
the ``RUN`` tokens from the seed on.  Any RUN + SPACING - 1 tokens in succession
hold such a seed, whatever surrounds them, and a stretch of MIN_TOKENS tokens of
which SHARE match has that many in succession: a passage can't lack one.

Each window is first held against the first one of its group.  Windows of a pair
of documents that lie in each other at one shift make regions; a region is
verified by matching tokens at about that shift.  A window that no passage so
verified covers is then held against all others of its group that have enough tokens in
common with it around the seed; of windows that are the same but for tokens that
no other one of the group has (a line in all documents), one stands for all, and
windows that others join already aren't tried.  So the result grows with the
windows, not with the pairs of those that share a passage.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship
from . import kernels as K
from .common import BROADCAST_BYTES, forget, join_ids, stored

#: Words of a token, tokens of the shortest stretch, functions that must agree, and the share of tokens of each stretch of MIN_TOKENS that must match (two changed words).
GRAM, MIN_TOKENS, AGREE, SHARE = 5, 40, 1, 0.75
#: Tokens that windows of a group have in common, and tokens among which one is a seed.  Two gaps leave (MIN_TOKENS * SHARE) / 3 tokens in succession, which is RUN + SPACING - 1.
RUN, SPACING = 4, 7
#: Tokens by which matches may be shifted within a passage, and words of the shortest passage.
SLACK, WORDS = 20, 50
#: Open windows of a group that one task holds; tokens of larger groups are joined where no more than FEW of the windows have them.
MANY, FEW = 200_000, 32
#: Windows of a group from which on those without enough common tokens are left out before any task holds it.
SOME = 50_000
_FN = np.random.Generator(np.random.PCG64(31)).integers(1, 2**63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOW = np.uint64(0xFFFFFFFF)
#: Regions begin and end at multiples of so many tokens: the stretches that are asked of one document are few, however many documents it is held against.
_GRID = 64
#: A window is packed as its centre and the tokens to its left and to its right; 63 stands for _FAR, in which two stretches of a passage lie whole.
_REACH, _FAR = 63, 2 * MIN_TOKENS + 5
#: Tokens to either side of a centre that may match in a region, and in a stretch that holds the centre.
_AROUND, _NEAR = _FAR + SLACK, MIN_TOKENS + SLACK


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return K.ngrams(*K.word_hashes(K.lower(texts)), GRAM)


def windows(toks: np.ndarray, docs: np.ndarray, fn: int, least: int = MIN_TOKENS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, centre, first, last) of the compact windows of at least ``least`` tokens; of equal hashes the leftmost counts as least."""
    n, d = len(toks), len(docs) - 1
    owner = np.repeat(np.arange(d), np.diff(docs))
    full = K.mix64(toks * _FN[fn] + np.uint64(fn + 1))
    value = np.zeros(n + d + 1, np.uint64)  # a 0 before each document and at the end bounds every span
    slot = np.arange(n) + owner + 1
    value[slot] = ((full >> np.uint64(32)) | np.uint64(1)) << np.uint64(32) | slot.astype(np.uint64)
    none = (np.zeros(0, np.int64),) * 4
    if len(value) < least:
        return none
    low, w = value, 1
    while 2 * w <= least:
        low = np.minimum(low[:-w], low[w:])
        w *= 2
    low = np.minimum(low[: len(value) - least + 1], low[least - w : len(value) - w + 1])
    low = low[low > _LOW]
    if not len(low):
        return none
    centre = (low & _LOW).astype(np.int64)
    centre = centre[np.concatenate([[True], centre[1:] != centre[:-1]])]
    # nearest smaller neighbours among centres and bounds (those of a centre are always among them)
    bounds = np.concatenate([docs[:-1] + np.arange(d), [n + d]])
    at = np.sort(np.concatenate([centre, bounds]))
    v = value[at]
    mine = np.flatnonzero(v > 0)
    before, after = np.arange(len(at)) - 1, np.arange(len(at)) + 1
    for link in (before, after):
        todo = mine
        while len(todo):
            todo = todo[v[link[todo]] > v[todo]]
            link[todo] = link[link[todo]]
    # a run of equal tokens would give a window for each; every (least/2)th covers the same
    h = value[centre] >> np.uint64(32)
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (np.diff(centre) >= least)])
    far = (centre - centre[np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))]) // (least // 2)
    keep = new | np.concatenate([[True], far[1:] != far[:-1]])
    centre, mine = centre[keep], mine[keep]
    doc = owner[centre - np.searchsorted(bounds, centre)]
    start = docs[doc] + doc + 1
    return doc, centre - start, at[before[mine]] + 1 - start, at[after[mine]] - 1 - start


def _stretch_hashes(toks: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n tokens from each place on."""
    p, inv = K.powers(len(toks) + 1)
    c = np.concatenate([[np.uint64(0)], np.cumsum(toks * p[: len(toks)], dtype=np.uint64)])
    return K.mix64((c[at + n] - c[at]) * inv[at])


def _keys(toks: np.ndarray, begin: np.ndarray) -> np.ndarray:
    return _stretch_hashes(toks, begin, RUN).view(np.int64)


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in K.text_chunks(batch.column(1)):
            toks, docs = tokens(batch.column(1).slice(a, b - a))
            doc, c, _, _ = windows(toks, docs, 0, SPACING)
            begin = docs[doc] + c
            inside = begin + RUN <= docs[doc + 1]
            doc, c, begin = (x[inside] for x in (doc, c, begin))
            key = _keys(toks, begin)
            same = (key[1:] == key[:-1]) & (doc[1:] == doc[:-1])  # of words that repeat at once, the ends
            ends = ~(np.append(False, same) & np.append(same, False)) if len(key) else np.zeros(0, bool)
            key, doc, c = (x[ends] for x in (key, doc, c))
            if len(doc):
                yield pa.RecordBatch.from_arrays([pa.array(key), batch.column(0).take(pa.array(doc + a)), pa.array(_packed(c))], ["key", "id", "win"])


def _packed(centre: np.ndarray) -> np.ndarray:
    return centre << 12 | _REACH << 6 | _REACH


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From windows in order of (key, id, window): each other window beside the first one of its key, further ones of the same document too.

    The first windows of the first and of the last key come as heads: their keys may go on in other partitions.
    """
    names = ["key", "a", "b", "wa", "wb", "head"]
    first = last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key, doc, win = (batch.column(k).to_numpy() for k in range(3))
        new = np.concatenate([[last is None or key[0] != last[0]], key[1:] != key[:-1]])
        at = np.maximum.accumulate(np.where(new, np.arange(len(key)), -1))
        a, wa = (x[np.maximum(at, 0)] for x in (doc, win))
        if at[0] < 0:
            a, wa = np.where(at < 0, last[1], a), np.where(at < 0, last[2], wa)
        first, last = first or (key[0], doc[0], win[0]), (key[-1], a[-1], wa[-1])
        other = (a != doc) | (wa != win)
        if other.any():
            yield pa.RecordBatch.from_arrays([*(pa.array(x[other]) for x in (key, a, doc, wa, win)), pa.array(np.zeros(int(other.sum()), bool))], names)
    if first is not None:
        key, doc, win = (np.array(x, np.int64) for x in zip(*dict.fromkeys([first, last])))
        yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in (key, doc, doc, win, win)), pa.array(np.ones(len(key), bool))], names)


def _unpacked(win: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centre, and the tokens to its left and right."""
    return win >> 12, (win >> 6) & _REACH, win & _REACH


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All values of a column of lists, and the rows that they are of."""
    size = np.diff(column.offsets.to_numpy())
    return column.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(column)), size)


def regions_of(pair: np.ndarray, fn: np.ndarray, wa: np.ndarray, wb: np.ndarray, agree: int = AGREE) -> np.ndarray:
    """(pair, first and last token on either side, shift) where windows of ``agree`` functions lie in each other on both sides: an interval join along each shift."""
    (ca, la, ra), (cb, lb, rb) = _unpacked(wa), _unpacked(wb)
    shift = cb - ca
    order = np.lexsort((shift, pair))
    p, d = pair[order], shift[order]
    cluster = np.cumsum(np.concatenate([[0], (p[1:] != p[:-1]) | (d[1:] != d[:-1])]))
    order = order[np.lexsort((ca[order], cb[order], cluster))]
    cluster = np.sort(cluster)
    pair, fn, shift, ca, la, ra, cb, lb, rb = (x[order] for x in (pair, fn, shift, ca, la, ra, cb, lb, rb))
    x, y = slice(None, -1), slice(1, None)
    step, back = cb[y] - cb[x], ca[y] - ca[x]
    meet = (step <= np.minimum(rb[x], lb[y])) & (np.abs(back) <= np.where(back >= 0, np.minimum(ra[x], la[y]), np.minimum(la[x], ra[y])))
    at = np.flatnonzero(np.concatenate([[True], (cluster[y] != cluster[x]) | ~meet]))
    run = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(shift))))
    enough = np.bincount(np.unique(run * 8 + fn) // 8, minlength=len(at)) >= agree
    low = lambda v: np.minimum.reduceat(v, at)[enough]
    high = lambda v: np.maximum.reduceat(v, at)[enough]
    near = lambda v: np.where(v < _REACH, v, _FAR)
    rows = [low(ca - near(la)), high(ca + near(ra)), low(cb - near(lb)), high(cb + near(rb))]
    if not enough.any():
        return np.zeros((0, 6), np.int64)
    # regions that overlap on both sides are one
    pair, shift, cluster = (v[at[enough]] for v in (pair, shift, cluster))
    apart = (cluster[y] != cluster[x]) | (rows[2][y] > rows[3][x]) | (rows[0][y] > rows[1][x]) | (rows[0][x] > rows[1][y])
    at = np.flatnonzero(np.concatenate([[True], apart]))
    la, ra, lb, rb = (f.reduceat(v, at) for f, v in zip((np.minimum, np.maximum) * 2, rows))
    return np.stack([pair[at], la, ra, lb, rb, shift[at]], axis=1)


def _regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        (wa, pair), (wb, _) = (_flat(batch.column(c)) for c in (2, 3))
        rows = regions_of(pair, np.zeros(len(pair), np.int64), wa, wb)
        if len(rows):
            rows[:, 1] -= SLACK
            rows[:, 2] += SLACK
            rows[:, [1, 3]] = np.maximum(rows[:, [1, 3]], 0)
            rows[:, [1, 3]] -= rows[:, [1, 3]] % _GRID
            rows[:, [2, 4]] += _GRID - 1 - rows[:, [2, 4]] % _GRID
            at = pa.array(rows[:, 0])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *(pa.array(rows[:, c]) for c in range(1, 6))], ["a", "b", "la", "ra", "lb", "rb", "shift"])


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The tokens, as 32-bit hashes, of the asked stretches (lists in columns 2 and 3) of each document."""
    names = ["id", "lo", "hi", "tokens"]
    for batch in batches:
        for s, e in K.text_chunks(batch.column(1)):
            toks, docs = tokens(batch.column(1).slice(s, e - s))
            codes = (toks >> np.uint64(32)).astype(np.uint32).view(np.int32)
            (lo, row), (hi, _) = (_flat(batch.column(c).slice(s, e - s)) for c in (2, 3))
            size = np.maximum(np.minimum(hi + 1, (docs[1:] - docs[:-1])[row]) - lo, 0)  # rows that repeat an id may be shorter
            for k in np.split(np.arange(len(lo)), np.flatnonzero(np.diff(np.cumsum(size) >> 20)) + 1):  # about a million tokens at once
                offs = np.concatenate([[0], np.cumsum(size[k])])
                place = np.arange(offs[-1]) + np.repeat(docs[row[k]] + lo[k] - offs[:-1], size[k])
                lists = pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(codes[place]))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row[k] + s)), pa.array(lo[k]), pa.array(hi[k]), lists], names)


def matched(ta: np.ndarray, ra: np.ndarray, ia: np.ndarray, tb: np.ndarray, rb: np.ndarray, ib: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """(row, first and last token on side b, least and greatest on side a) of the passages of rows of tokens.

    ta, ra, ia are the tokens of side a with their rows and places, in order; likewise of side b; shift has a number for each
    row.  A token of b matches the equal one of a that is nearest to its own place less the shift, at most SLACK off; each
    token of a is matched once.  A passage is a union of stretches of MIN_TOKENS tokens of which SHARE match.
    """
    none = np.zeros((0, 5), np.int64)
    if len(ta) == 0 or len(tb) < MIN_TOKENS:
        return none
    name = lambda t, r: r.astype(np.uint64) << np.uint64(32) | t.view(np.uint32).astype(np.uint64)
    known, rank = np.unique(name(ta, ra), return_inverse=True)
    there = np.sort(rank.astype(np.int64) << 32 | ia)
    asked = name(tb, rb)
    rank = np.minimum(np.searchsorted(known, asked), len(known) - 1)
    want = np.maximum(ib - shift[rb], 0)
    goal = rank.astype(np.int64) << 32 | want
    pos = np.searchsorted(there, goal)
    best, off = np.zeros(len(tb), np.int64), np.full(len(tb), SLACK + 1)
    for k in (pos, pos - 1):
        got = there[np.clip(k, 0, len(there) - 1)]
        mine = np.where((k >= 0) & (k < len(there)) & (got >> 32 == rank), np.abs((got & 0xFFFFFFFF) - want), SLACK + 1)
        best, off = np.where(mine < off, got & 0xFFFFFFFF, best), np.minimum(off, mine)
    hit = np.flatnonzero((off <= SLACK) & (known[rank] == asked))
    hit = hit[np.sort(np.unique(rb[hit] << 32 | best[hit], return_index=True)[1])]
    flag = np.zeros(len(tb), np.int64)
    flag[hit] = 1
    total = np.concatenate([[0], np.cumsum(flag)])
    good = np.flatnonzero((total[MIN_TOKENS:] - total[:-MIN_TOKENS] >= SHARE * MIN_TOKENS) & (rb[MIN_TOKENS - 1 :] == rb[: len(rb) - MIN_TOKENS + 1]))
    if not len(good):
        return none
    cut = np.concatenate([[True], (np.diff(good) > MIN_TOKENS) | (rb[good[1:]] != rb[good[:-1]])])
    begin, end = good[cut], np.append(good[np.flatnonzero(cut)[1:] - 1], good[-1]) + MIN_TOKENS
    x, y = np.searchsorted(hit, begin), np.searchsorted(hit, end)
    i = best[hit]
    ends = np.stack([x, y], axis=1).ravel()
    padded = np.append(i, 0)
    least, most = np.minimum.reduceat(padded, ends)[::2], np.maximum.reduceat(padded, ends)[::2]
    return np.stack([rb[begin], ib[hit[x]], ib[hit[y - 1]], least, most], axis=1)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (b, a, la, tokens of a, lb, tokens of b, shift) to passages."""
    for batch in batches:
        size = np.cumsum(np.diff(batch.column(3).offsets.to_numpy()) + np.diff(batch.column(5).offsets.to_numpy()))
        for s, e in zip(*(lambda c: (np.append(0, c), np.append(c, batch.num_rows)))(np.flatnonzero(np.diff(size >> 18)) + 1)):
            part = batch.slice(int(s), int(e - s))
            (ta, ra), (tb, rb) = _flat(part.column(3)), _flat(part.column(5))
            la, lb, shift = (part.column(c).to_numpy() for c in (2, 4, 6))
            place = lambda r, first: np.arange(len(r)) - np.searchsorted(r, r) + first[r]
            rows = matched(ta, ra, place(ra, la), tb, rb, place(rb, lb), shift)
            rows = rows[np.maximum(rows[:, 2] - rows[:, 1], rows[:, 4] - rows[:, 3]) + GRAM >= WORDS]
            if len(rows):
                at = pa.array(rows[:, 0])
                cols = rows[:, 1], rows[:, 2] - rows[:, 1] + GRAM, rows[:, 3], rows[:, 4] - rows[:, 3] + GRAM
                yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at), *map(pa.array, cols)], _NAMES)


_NAMES = ["doc_id", "other_doc_id", "first_word", "n_words", "other_first_word", "other_n_words"]
_PASSAGE = ", ".join(f"{c} bigint" for c in _NAMES)


def _asking(rows: DataFrame, asked: DataFrame, bytes_each: int) -> DataFrame:
    """rows (id, text) beside the lists that are asked of them; ``asked`` is broadcast if its measured size allows."""
    lists = [c for c in asked.columns if c != "id"]
    size = asked.agg(F.sum(F.size(lists[0]) * bytes_each + 64)).first()[0] or 0
    return rows.join(F.broadcast(asked) if size <= BROADCAST_BYTES else asked, "id").select("id", "text", *lists)


def _verified(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """Passages of the pairs of documents whose windows agree, from (a, b, wa, wb)."""
    pairs = edges.groupBy("a", "b").agg(F.collect_list("wa").alias("wa"), F.collect_list("wb").alias("wb"))
    regions = pairs.mapInArrow(_regions, "a bigint, b bigint, la bigint, ra bigint, lb bigint, rb bigint, shift bigint")
    regions = stored(regions, "regions")
    asked = regions.selectExpr("a as id", "la as lo", "ra as hi").unionAll(regions.selectExpr("b", "lb", "rb")).distinct()
    asked = stored(asked.groupBy("id").agg(F.collect_list("lo").alias("lo"), F.collect_list("hi").alias("hi")), "asked")
    slices = stored(_asking(rows, asked, 16).mapInArrow(_slices, "id bigint, lo bigint, hi bigint, tokens array<int>"), "slices")
    left, right = slices.selectExpr("id as a", "lo as la", "hi as ra", "tokens as ta"), slices.selectExpr("id as b", "lo as lb", "hi as rb", "tokens as tb")
    both = regions.join(left, ["a", "la", "ra"]).join(right, ["b", "lb", "rb"]).select("b", "a", "la", "ta", "lb", "tb", "shift")
    return both.mapInArrow(_verify, _PASSAGE).distinct()


def _asked_places(batch: pa.RecordBatch) -> Iterator[tuple]:
    """Tokens of a chunk, and of the asked windows (column 2: twice the centre, and 1 if open) centres among them, first and last token of what can match in a region; their keys, ids, windows, whether they are open, and labels (column 3)."""
    for s, e in K.text_chunks(batch.column(1)):
        toks, docs = tokens(batch.column(1).slice(s, e - s))
        asked, row = _flat(batch.column(2).slice(s, e - s))
        label, _ = _flat(batch.column(3).slice(s, e - s))
        centre = docs[row] + (asked >> 1)
        there = centre + RUN <= docs[row + 1]  # rows that repeat an id may be shorter
        asked, row, centre, label = (x[there] for x in (asked, row, centre, label))
        codes = (toks >> np.uint64(32)).astype(np.uint32).view(np.int32)
        for k in np.split(np.arange(len(row)), np.arange(5000, len(row), 5000)):
            low, high = np.maximum(centre[k] - _AROUND, docs[row[k]]), np.minimum(centre[k] + _AROUND + 1, docs[row[k] + 1])
            yield codes, centre[k], low, high, _keys(toks, centre[k]), batch.column(0).take(pa.array(row[k] + s)), _packed(asked[k] >> 1), (asked[k] & 1).astype(bool), label[k]


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, id, window, open, label, tokens around) of the asked windows; the tokens are 32-bit numbers, 0 where the document has none."""
    for batch in batches:
        for codes, centre, low, high, key, ids, win, is_open, label in _asked_places(batch):
            place = centre[:, None] + np.arange(-_AROUND, _AROUND + 1)
            inside = (place >= low[:, None]) & (place < high[:, None])
            flat = np.where(inside, codes[np.where(inside, place, 0)] | 1, 0).astype(np.int32)
            width = flat.shape[1] * 4
            around = pa.Array.from_buffers(pa.binary(), len(flat), [None, pa.py_buffer(np.arange(0, (len(flat) + 1) * width, width, dtype=np.int32)), pa.py_buffer(flat)])
            yield pa.RecordBatch.from_arrays([pa.array(key), ids, pa.array(win), pa.array(is_open), pa.array(label), around], ["key", "id", "win", "open", "label", "around"])


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, id, window, open, place from the centre, token) of the tokens around the asked windows."""
    names = ["key", "id", "win", "open", "off", "token"]
    for batch in batches:
        for codes, centre, low, high, key, ids, win, is_open, _ in _asked_places(batch):
            size = high - low
            at = np.repeat(np.arange(len(size)), size)
            place = np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size) + low[at]
            cols = win[at], is_open[at], (place - centre[at]).astype(np.int32), codes[place]
            yield pa.RecordBatch.from_arrays([pa.array(key[at]), ids.take(pa.array(at)), *map(pa.array, cols)], names)


def _alike(side_a: np.ndarray, side_b: np.ndarray) -> np.ndarray:
    """Rows (-1 for no token) of which a stretch of b that holds the centre has SHARE of its tokens in a, at most SLACK off: no pair that shares a passage lacks it."""
    far, out = MIN_TOKENS - 1, np.zeros(len(side_a), bool)
    for k in range(0, len(side_a), 256):  # few enough that what is compared stays in the cache; places by rows, so that a shift is one piece of memory
        a, b = (np.ascontiguousarray(x[k : k + 256, _AROUND - w : _AROUND + w + 1].T) for x, w in ((side_a, far + SLACK), (side_b, far)))
        hit, same = a[: len(b)] == b, np.empty(b.shape, bool)
        for d in range(1, 2 * SLACK + 1):
            np.equal(a[d : d + len(b)], b, out=same)
            hit |= same
        hit &= b >= 0
        total = np.zeros((len(b) + 1, b.shape[1]), np.int8)
        np.cumsum(hit, axis=0, dtype=np.int8, out=total[1:])
        out[k : k + 256] = (total[MIN_TOKENS:] - total[:-MIN_TOKENS]).max(0) >= SHARE * MIN_TOKENS
    return out


def _repeats(code: np.ndarray) -> np.ndarray:
    """Rows (-1 for no token) that share a passage around their centres with any row that is the same."""
    n = 2 * _FAR + 1
    hit = code[:, SLACK : SLACK + n] >= 0
    total = np.zeros((len(hit), n + 1), np.int16)
    np.cumsum(hit, axis=1, dtype=np.int16, out=total[:, 1:])
    good = total[:, MIN_TOKENS:] - total[:, :-MIN_TOKENS] >= SHARE * MIN_TOKENS
    begin, end = good.argmax(1), good.shape[1] - 1 - good[:, ::-1].argmax(1) + MIN_TOKENS
    at = np.arange(n)
    hit &= (at >= begin[:, None]) & (at < end[:, None])
    return good[:, _FAR - MIN_TOKENS + 1 : _FAR + 1].any(1) & (n - 1 - hit[:, ::-1].argmax(1) - hit.argmax(1) >= WORDS - GRAM)


def _same_passages(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows of tokens (0 for none) of a have a passage that holds the centres with those of b, as :func:`matched` finds it: all pairs at once."""
    if len(b) > 256:
        return np.concatenate([_same_passages(a[k : k + 256], b[k : k + 256]) for k in range(0, len(b), 256)])
    k, n = b.shape
    if not k:
        return np.zeros(0, bool)
    at, row = np.arange(n), np.arange(k)[:, None]
    there = b != 0
    near = sorted(range(-SLACK, SLACK + 1), key=lambda d: (-abs(d), d))  # the nearest one is the last
    wide, flat = np.zeros((n + 2 * SLACK, k), a.dtype), np.ascontiguousarray(b.T)
    wide[SLACK:-SLACK] = a.T
    best, same = np.zeros(flat.shape, np.uint8), np.empty(flat.shape, bool)
    for rank, d in enumerate(near, 1):
        np.equal(wide[SLACK + d : SLACK + d + n], flat, out=same)
        np.maximum(best, same.view(np.uint8) * np.uint8(rank), out=best)
    best = best.T
    hit = (best > 0) & there
    off = np.array([0, *near], np.int64)[best]
    # each token of a is matched once, by the first one of b
    place = at + off
    y, x = (v[::-1] for v in np.nonzero(hit))
    first = np.zeros(b.shape, np.int16)
    first[y, place[y, x]] = x  # of those that repeat the last one stays
    hit[y, x] = first[y, place[y, x]] == x
    total = np.zeros((k, n + 1), np.int16)
    np.cumsum(hit, axis=1, dtype=np.int16, out=total[:, 1:])
    good = (total[:, MIN_TOKENS:] - total[:, :-MIN_TOKENS] >= SHARE * MIN_TOKENS) & there[:, : n - MIN_TOKENS + 1] & there[:, MIN_TOKENS - 1 :]
    # the union of stretches, none more than MIN_TOKENS from the next, that the centre is in
    start = np.arange(good.shape[1])
    last = np.maximum.accumulate(np.where(good, start, -n), axis=1)
    before = np.concatenate([np.full((k, 1), -n), last[:, :-1]], axis=1)
    mine = last[:, _AROUND]
    begin = np.maximum.accumulate(np.where(good & (start - before > MIN_TOKENS), start, 0), axis=1)[row[:, 0], np.maximum(mine, 0)]
    after = good & (start - before > MIN_TOKENS) & (start > mine[:, None])
    end = np.where(after.any(1), before[row[:, 0], after.argmax(1)], last[:, -1]) + MIN_TOKENS
    hit &= (at >= begin[:, None]) & (at < end[:, None])
    low, high = hit.argmax(1), n - 1 - hit[:, ::-1].argmax(1)
    least, most = np.where(hit, place, n).min(1), np.where(hit, place, -n).max(1)
    return (mine > _AROUND - MIN_TOKENS) & (low <= _AROUND) & (high >= _AROUND) & (np.maximum(high - low, most - least) + GRAM >= WORDS)


def _sharing(code: np.ndarray, some: np.ndarray) -> Callable[[int, np.ndarray, np.ndarray], np.ndarray]:
    """A function that gives, of a row of tokens (-1 for none), those of other components that can share a passage with it, the likeliest first; of two rows with ``some`` the first one gives the other.

    Each token of a row is matched once, so that the k-th one of a row counts with the k-th equal one of another; such
    elements are ordered by the rows that have them, rare ones first.  Of rows with SHARE * MIN_TOKENS elements in common
    none but the last SHARE * MIN_TOKENS - 1 of each can be the only ones: the rest of the two has one in common.  So what
    all rows of a group have isn't looked up.

    Rows whose one common token repeats in one run (junk of one word) share a passage only if the runs lie so that WORDS words match.
    """
    least = int(SHARE * MIN_TOKENS)
    near = code[:, _AROUND - _NEAR : _AROUND + _NEAR + 1]
    owner, place = np.nonzero(near >= 0)
    token = near[owner, place].astype(np.int64)
    order = np.argsort(owner << 32 | token, kind="stable")
    owner, token = owner[order], token[order]
    new = np.append(True, (owner[1:] != owner[:-1]) | (token[1:] != token[:-1]))
    at = np.arange(len(token))
    element, n = np.unique(token << 8 | at - np.maximum.accumulate(np.where(new, at, 0)), return_inverse=True, return_counts=True)[1:]
    by_rarity = np.empty(len(n), np.int64)
    by_rarity[np.argsort(n, kind="stable")] = np.arange(len(n))
    element = by_rarity[element.ravel()]
    order = np.argsort(owner << 32 | element, kind="stable")
    element = element[order]  # owner is in order already
    begin = np.searchsorted(owner, np.arange(len(code) + 1))
    lead = at < begin[owner + 1] - least + 1
    order = np.argsort(element[lead], kind="stable")
    lists, keys = owner[lead][order], element[lead][order]
    has = np.zeros(len(n), bool)
    # rows that repeat the centre's token least times: its run at the centre, the next ones beyond it, and whether no other one is in a dense stretch
    main = code[:, _AROUND]
    there = (code == main[:, None]) & (main >= 0)[:, None]
    at, far = np.arange(code.shape[1]), 1 << 20
    low = np.where(~there & (at <= _AROUND), at, -1).max(1) + 1
    high = np.where(~there & (at >= _AROUND), at, code.shape[1]).min(1) - 1
    inside = (at >= low[:, None]) & (at <= high[:, None])
    before = np.where(there & (at < low[:, None]), at, -far).max(1)
    after = np.where(there & (at > high[:, None]), at, far).min(1)
    total, own = (np.cumsum(np.pad(v, ((0, 0), (1, 0))), axis=1, dtype=np.int16) for v in (there, inside))
    total, own = (v[:, MIN_TOKENS:] - v[:, :-MIN_TOKENS] for v in (total, own))
    run = (there[:, _AROUND - _NEAR : _AROUND + _NEAR + 1].sum(1) >= least) & ((total < least) | (total == own)).all(1)
    ran = np.flatnonzero(run)
    i, j = np.nonzero((code[ran] >= 0) & ~there[ran])
    other = np.unique(code[ran][i, j].astype(np.int64) << 32 | ran[i])
    other_token, other_row = other >> 32, other & 0xFFFFFFFF
    shares = np.zeros(len(code), bool)

    def candidates(x: int, joined: np.ndarray, name: np.ndarray) -> np.ndarray:
        mine = element[begin[x] : begin[x + 1]]
        asked = mine[: max(len(mine) - least + 1, 0)]
        s, e = np.searchsorted(keys, asked), np.searchsorted(keys, asked, "right")
        y = np.unique(np.concatenate([lists[i:j] for i, j in zip(s.tolist(), e.tolist())])) if len(asked) else np.zeros(0, np.int64)
        y = y[(joined[name[y]] != joined[name[x]]) & (~some[y] | (y > x))]
        if run[x]:
            here = np.unique(code[x][(code[x] >= 0) & (code[x] != main[x])])
            s, e = np.searchsorted(other_token, here), np.searchsorted(other_token, here, "right")
            also = np.concatenate([other_row[i:j] for i, j in zip(s.tolist(), e.tolist())]) if len(here) else np.zeros(0, np.int64)
            shares[also] = True
            # the first token of the later run is matched by the first one near it of the other
            miss = MIN_TOKENS - least
            begins = np.minimum(np.maximum(low[y], low[x] - miss), np.maximum(low[x], low[y] - miss))
            short = np.minimum(high[x], high[y]) - begins < WORDS - GRAM
            apart = (np.minimum(after[x] - high[y], after[y] - high[x]) > SLACK) & (np.minimum(low[y] - before[x], low[x] - before[y]) > SLACK)
            y = y[~(run[y] & (main[y] == main[x]) & ~shares[y] & short & apart)]
            shares[also] = False
        if not len(y):
            return y
        has[mine] = True
        size = begin[y + 1] - begin[y]
        ends = np.cumsum(size)
        common = np.add.reduceat(has[element[np.arange(ends[-1]) + np.repeat(begin[y] - ends + size, size)]], ends - size, dtype=np.int64)
        has[mine] = False
        y, common = y[common >= least], common[common >= least]
        return y[np.argsort(-common, kind="stable")]

    return candidates


def linked(around: np.ndarray, ids: np.ndarray, is_open: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Pairs of rows that share a passage around the centres of a group's windows: enough to join all that such passages join.

    ``around`` has a row of tokens for each window, in order of ids; rows of one label are joined already.  Each open row is held
    against all others that it isn't joined with by then and that have enough tokens in common with it.  Tokens that one row has
    alone don't count; rows that are the same in all others count as one.
    """
    none, least = np.zeros((0, 2), np.int64), int(SHARE * MIN_TOKENS)
    inner = slice(_AROUND - _NEAR, _AROUND + _NEAR + 1)
    row = np.arange(len(around))
    # tokens with their places, in one sort
    each = around.view(np.uint32).ravel().astype(np.uint64) << np.uint64(32) | np.arange(around.size, dtype=np.uint64)
    each.sort()
    at = (each & _LOW).astype(np.int64)
    new = np.append(True, each[1:] >> np.uint64(32) != each[:-1] >> np.uint64(32))
    rank, of = np.cumsum(new) - 1, at // around.shape[1]
    new = new | np.append(True, ids[of[1:]] != ids[of[:-1]])
    n = np.bincount(rank, new)  # documents that have it: what one has alone matches nothing of another's
    code = np.empty(around.size, np.int32)
    code[at] = np.where(n[rank] > 1, rank, -1)
    code = np.where(around != 0, code.reshape(around.shape), np.int32(-1))
    enough = (code[:, inner] >= 0).sum(1) >= least
    row, code = row[enough], code[enough]
    if len(row) < 2 or not is_open[row].any():
        return none
    _, first, kind = np.unique(np.ascontiguousarray(code).view(f"V{4 * code.shape[1]}").ravel(), return_index=True, return_inverse=True)
    kind, id_of, code = kind.ravel(), ids[row], code[first]
    some = np.bincount(kind, is_open[row], len(first)) > 0
    last = np.zeros(len(first), np.int64)
    last[kind] = np.arange(len(row))  # rows are in order: the last one stays
    found: list[tuple[int, int]] = []
    mark = np.unique(label[row], return_inverse=True)[1].ravel()
    names = int(mark.max()) + 1
    joined = np.arange(names + len(first))  # components of labels, and of kinds whose rows aren't joined yet
    of_comp = {k: [k] for k in range(len(joined))}
    name = mark[first]  # of kinds
    # one row of each label and kind
    each = np.unique(kind * np.int64(names) + mark, return_index=True)[1]
    bounds = np.append(np.searchsorted(kind[each], np.arange(len(first))), len(each))
    passes = np.concatenate([_repeats(code[k : k + 2000]) for k in range(0, len(first), 2000)])
    whole = (np.diff(bounds) == 1) | passes

    def merge(p: int, q: int) -> None:
        """The smaller component goes into the other one."""
        p, q = sorted((int(joined[p]), int(joined[q])), key=lambda c: len(of_comp[c]))
        if p != q:
            joined[of_comp[p]] = q
            of_comp[q] += of_comp.pop(p)

    def join(k: int, beside: int | None = None) -> None:
        """The rows of a kind, each beside a row, or beside another one of the kind."""
        mine = each[bounds[k] : bounds[k + 1]]
        other = np.full(len(mine), beside) if beside is not None else np.where(id_of[mine] == id_of[first[k]], last[k], first[k])
        apart = (id_of[mine] != id_of[other]) & (joined[mark[mine]] != joined[mark[other]])
        found.extend(zip(mine[apart].tolist(), other[apart].tolist()))
        for m in mark[mine].tolist():
            merge(m, name[k])

    for k in np.flatnonzero(passes & (np.diff(bounds) > 1)):
        join(k)
    name[~whole] = names + np.flatnonzero(~whole)
    candidates = _sharing(code, some)
    for x in np.flatnonzero(some) if len(np.unique(joined[name])) > 1 else ():
        y, part = candidates(x, joined, name), 256
        while len(y):
            now, y = y[:part], y[part:]
            part = min(4 * part, 4096)
            # of each pair the row of the greater id is side b; kinds of several documents can have it on either side
            p, q = np.repeat([first[x], last[x]], len(now)), np.concatenate([last[now], first[now]])
            now, p, q = (v[np.where(np.arange(len(p)) < len(now), id_of[p] < id_of[q], id_of[p] > id_of[q])] for v in (np.tile(now, 2), p, q))
            less = (id_of[p] < id_of[q])[:, None]
            ok = np.flatnonzero(_alike(np.where(less, code[x], code[now]), np.where(less, code[now], code[x])))
            a, b = row[np.minimum(p[ok], q[ok])], row[np.maximum(p[ok], q[ok])]
            for k in ok[_same_passages(around[a], around[b])]:
                if joined[name[now[k]]] != joined[name[x]]:
                    found.append((p[k], q[k]))
                    for one, beside in ((x, q[k]), (now[k], p[k])):
                        if not whole[one]:
                            join(one, beside)
                            whole[one] = True
                    merge(name[now[k]], name[x])
            y = y[joined[name[y]] != joined[name[x]]]
    if not found:
        return none
    return np.sort(row[np.array(found, np.int64).reshape(-1, 2)], axis=1)


def _group(group: pa.Table) -> pa.Table:
    """Edges of one key's windows (id, win, open, label, around)."""
    group = group.select(["id", "win", "open", "label", "around"]).combine_chunks().sort_by([("id", "ascending"), ("win", "ascending")])
    ids, win, is_open, label = (group.column(c).to_numpy() for c in ("id", "win", "open", "label"))
    around = np.frombuffer(b"".join(group.column("around").to_pylist()), np.int32).reshape(len(ids), -1)
    x, y = linked(around, ids, is_open, label).T
    return pa.table({"a": ids[x], "b": ids[y], "wa": win[x], "wb": win[y]})


def _between(x: str, y: str) -> list[Column]:
    """The places (structs of id and win) x and y as columns of an edge."""
    p, q = F.expr(f"least({x}, {y})"), F.expr(f"greatest({x}, {y})")
    return [p["id"].alias("a"), q["id"].alias("b"), p["win"].alias("wa"), q["win"].alias("wb")]


def _crossed(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Edges between the open places x of left and the places y of right that agree in ``on``."""
    both = left.where("open").select(*on, F.struct("id", "win").alias("x")).join(right.select(*on, F.struct("id", "win").alias("y"), F.col("open").alias("too")), on)
    return both.where("x.id <> y.id and (not too or x.id < y.id)").select(*_between("x", "y"))


def _rest(rows: DataFrame, edges: DataFrame, passages: DataFrame) -> DataFrame:
    """Edges (a, b, wa, wb) from each window that no passage shared with its key's first one covers to the others of the key that it can match."""
    spans = stored(passages.groupBy(F.col("other_doc_id").alias("a"), F.col("doc_id").alias("b")).agg(F.collect_list(F.struct("first_word", "n_words")).alias("spans")), "spans")
    covered = F.expr(f"exists(spans, s -> shiftright(wb, 12) between s.first_word and s.first_word + s.n_words - {GRAM})")
    marked = join_ids(edges, spans, ["a", "b"], "left", 96).select("key", "a", "b", "wa", "wb", (F.expr("a <> b") & ~F.coalesce(covered, F.lit(False))).alias("open"))
    marked = stored(marked, "marked")
    keys = stored(marked.groupBy("key").agg(F.count("*").alias("n"), F.max("open").alias("some")).where("some and n > 1").select("key", "n"), "open")
    mine = join_ids(marked, keys, "key", "inner", 40)
    # first windows too: those of a key over several partitions were held against their own partition's only
    # covered windows have the label of the first one, all others their own
    mine = mine.selectExpr("key", "n", "b as id", "wb as win", "open", "if(open or a = b, xxhash64(b, wb), xxhash64(a, wa)) as label").unionAll(mine.selectExpr("key", "n", "a", "wa", "false", "xxhash64(a, wa)"))
    others = stored(mine.groupBy("key", "n", "id", "win").agg(F.max("open").alias("open"), F.min_by("label", F.struct("open", F.expr("label = xxhash64(id, win)"))).alias("label")), "members")
    edges = "a bigint, b bigint, wa bigint, wb bigint"
    asking = lambda some: stored(some.groupBy("id").agg(F.collect_set(F.struct(F.expr("shiftright(win, 12) * 2 + int(open)").alias("c"), "label")).alias("s")).select("id", "s.c", "s.label"), "asked")
    others = _thinned(rows, others, asking)
    around = _asking(rows, asking(others.where(f"n <= {MANY}")), 16).mapInArrow(_contexts, "key bigint, id bigint, win bigint, open boolean, label bigint, around binary")
    found = stored(around.groupBy("key").applyInArrow(_group, edges).distinct(), "linked")
    many = others.where(f"n > {MANY}")
    return found if many.isEmpty() else found.unionAll(_rest_of_many(rows, asking(many))).distinct()


def _thinned(rows: DataFrame, members: DataFrame, asking: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The members, of large groups only those that have enough tokens around their centres in common with other documents, as :func:`linked` would leave the rest out."""
    large = members.where(f"n > {SOME}")
    if large.isEmpty():
        return members
    around = _asking(rows, asking(large), 8).mapInArrow(_exploded, "key bigint, id bigint, win bigint, open boolean, off int, token int")
    around = stored(around.selectExpr("key", "id", "win", "off", "token | 1 as token"), "around")
    common = around.groupBy("key", "token").agg(F.min("id").alias("x"), F.max("id").alias("y")).where("x <> y").select("key", "token")
    enough = around.where(f"abs(off) <= {_NEAR}").join(common, ["key", "token"]).groupBy("key", "id", "win").count().where(f"count >= {int(SHARE * MIN_TOKENS)}")
    kept = stored(large.drop("n").join(enough.drop("count"), ["key", "id", "win"]), "kept")
    sizes = kept.groupBy("key").agg(F.count("*").alias("n"))
    return stored(members.where(f"n <= {SOME}").unionByName(kept.join(F.broadcast(sizes), "key")), "thinned")


def _rest_of_many(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """Edges to all that :func:`linked` would try, by joins: for groups that no task should hold."""
    around = stored(_asking(rows, asked, 8).mapInArrow(_exploded, "key bigint, id bigint, win bigint, open boolean, off int, token int"), "contexts")
    counts = around.groupBy("key", "token").agg(F.count("*").alias("n")).where("n > 1")
    around = stored(around.join(counts, ["key", "token"]), "common")
    rare = around.where(f"n <= {FEW}")
    # what only frequent tokens make alike: windows that have these at the same places stand for each other
    alike = around.where(f"n > {FEW}").groupBy("key", "id", "win", "open").agg(F.xxhash64(F.sort_array(F.collect_list(F.struct("off", "token")))).alias("kind"))
    alike = stored(alike, "alike")
    kinds = stored(alike.groupBy("key", "kind").agg(F.min(F.struct("id", "win")).alias("x"), F.max(F.struct("id", "win")).alias("z"), F.max("open").alias("some")), "kinds")
    copies = alike.join(kinds, ["key", "kind"]).where("open or some").select(F.struct("id", "win").alias("y"), F.expr("if(id = x.id, z, x)").alias("x")).where("x.id <> y.id").select(*_between("x", "y"))
    heads = kinds.select("key", F.col("x.id").alias("id"), F.col("x.win").alias("win"), F.col("some").alias("open"))
    return _crossed(rare, rare, ["key", "token"]).unionAll(copies).unionAll(_crossed(heads, heads, ["key"])).distinct()


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, other_doc_id, first_word, n_words, other_first_word, other_n_words): passages of doc_id that other_doc_id has too.

    A passage has at least 50 words on one side, and of each stretch of 40 word 5-grams (lower case, punctuation ignored) at least 75 %
    (two words changed) occur in the other document's passage, at most 20 words off their place.  A passage that many documents share is paired with
    the document of the least id among those with the same seed, so that the result grows with the documents that share it and
    not with their pairs.  Two documents that have such a passage are linked, by a passage between them or with documents that
    share it there; none depends on chance.  (A passage holds 14 words in succession that are the same, which is sure unless
    words repeat so closely that neighbouring tokens match at different shifts.)  Ids must be integers.  Repetition within one
    document isn't reported.
    Null ids and texts are skipped; rows that repeat an id count as one document; an empty table gives no rows; other columns are not read.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null and text is not null")
    wins = stored(rows.mapInArrow(_emit, "key bigint, id bigint, win bigint"), "windows")
    # ranges rather than hashes: a key that many windows have is spread over several tasks
    ordered = wins.repartitionByRange("key", "id").sortWithinPartitions("key", "id", "win")
    near = stored(ordered.mapInArrow(_stars, "key bigint, a bigint, b bigint, wa bigint, wb bigint, head boolean"), "edges")
    forget(wins)
    heads = near.where("head").select("key", F.struct("a", "wa").alias("w")).distinct()  # two for each task
    heads = heads.join(heads.groupBy("key").agg(F.min("w").alias("m")), "key").where("w <> m").selectExpr("key", "m.a as a", "w.a as b", "m.wa as wa", "w.wa as wb")
    edges = near.where("not head").drop("head").unionByName(stored(heads, "heads"))
    stars = stored(_verified(rows, edges.where("a <> b")), "passages")
    return stars.unionAll(_verified(rows, _rest(rows, edges, stars))).distinct()
