"""Exact removal of repeated byte strings by blockwise sorting with a difference cover.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts in a document with a
smaller id. All suffixes of a corpus cannot be shuffled for that: at 16 bytes each they are
many times the input. So suffixes are dealt into blocks by content first. The smallest hash
among the 16-byte grams of a window of ``LENGTH`` bytes is its anchor; equal windows have equal
anchors at the same place, so they meet in one block. Neighbouring windows share an anchor,
which stands for about twenty of them.

1. Each task counts the anchors of its texts; a block that has seen all of an anchor's counts
   knows if two documents hold it. The answer is a bit table, limited to ``FILTER_BYTES`` in
   all; where it is crowded it lets more through, never less.
2. Anchors that pass are sent to their block with the bytes around them. Equal surroundings
   are met by the smallest document; inside a task that is done before anything is sent.
3. In a block, the windows of differing surroundings are sorted by their first eight bytes.
   Ties are resolved by ranks of a difference cover of period seven: the 44-byte strings at
   three of seven places are ranked beforehand, and any two windows are at a common distance
   of a ranked place, so no window is compared beyond its head, tail and one rank.

An anchor with more than ``crowd`` surroundings would make a block too large; its windows are
dealt out one by one by their own content instead, which is exact as well.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acuity.llm.common import bounded_batches, in_table, key_place, key_table, stage, texts

LENGTH, GRAM = 50, 16
FILTER_BYTES, CROWD, MOST_CROWDED = 64 << 20, 100_000, 1 << 16
_PIECE, _HELD, _PART = 1 << 19, 16 << 20, 1 << 20
#: Bytes of a block that a task unpacks at once; what it has not come to stays compressed.
_OPEN = 32 << 20
_BASE = 0x9E3779B97F4A7C15
_COVER, _PERIOD = (0, 1, 3), 7
_MASK = (1 << 64) - 1


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ h >> np.uint64(29)


_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> list[np.ndarray]:
    if len(_powers[0]) <= n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(n + 1, base, dtype=np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers


def _sums(raw: np.ndarray, salt: int = 1) -> np.ndarray:
    """Running sums from which any substring's hash follows."""
    out = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_mix(raw.astype(np.uint64) + np.uint64(salt)) * _power(len(raw))[0][: len(raw)],
              out=out[1:])
    return out


def _hash(sums: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    return _mix((sums[stop] - sums[start]) * _power(len(sums))[1][start])


def _runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indexes of runs laid end to end."""
    shift = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
    return np.arange(len(shift)) + shift


def _pieces(batch: list[bytes | None], length: int) -> Iterator[tuple]:
    """Groups of about one megabyte: bytes, starts, the row of each piece, its place in it.

    A longer text comes in pieces that overlap by less than a window, so that every window
    is in one piece.
    """
    held, rows, places, size = [], [], [], 0

    def group():
        starts = np.concatenate([[0], np.cumsum([len(h) for h in held])]).astype(np.int64)
        return (np.frombuffer(b"".join(held), np.uint8), starts,
                np.array(rows, np.int64), np.array(places, np.int64))

    for row, text in enumerate(batch):
        text = text or b""
        for at in range(0, max(1, len(text) - length + 1), _PIECE):
            held.append(text[at : at + _PIECE + length - 1])
            rows.append(row)
            places.append(at)
            size += len(held[-1])
            if size >= _PIECE:
                yield group()
                held, rows, places, size = [], [], [], 0
    if held:
        yield group()


def _anchors(raw: np.ndarray, starts: np.ndarray, length: int, gram: int):
    """Anchor hash, first and last window, and piece of each run of windows with one anchor."""
    none = (np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3)
    n = len(raw) - length + 1
    if n < 1:
        return none
    sums = _sums(raw)
    every = np.arange(len(raw) - gram + 1)
    h = _hash(sums, every, every + gram)
    least = (h & np.uint64(_MASK ^ 0xFFFFFF)) | every.astype(np.uint64)
    wide, step = length - gram + 1, 1
    while step * 2 <= wide:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    if wide > step:
        least = np.minimum(least[: n], least[wide - step : wide - step + n])
    at = (least[:n] & np.uint64(0xFFFFFF)).astype(np.int64)
    piece = np.repeat(np.arange(len(starts) - 1), np.diff(starts))[:n]
    whole = np.arange(n) + length <= starts[piece + 1]
    new = np.append(True, (at[1:] != at[:-1]) | (piece[1:] != piece[:-1]))
    first = np.flatnonzero(new & whole)
    ends = np.append(np.flatnonzero(new)[1:], n)
    # a piece's last whole window ends its last run
    last = np.minimum(ends[np.searchsorted(np.flatnonzero(new), first)],
                      np.maximum(starts[piece[first] + 1] - length + 1, 0)) - 1
    return h[at[first]], first, last, piece[first]


def window_minima(raw: np.ndarray, at: np.ndarray, owner: np.ndarray, length: int) -> np.ndarray:
    """For each window, the least ``owner`` among the windows with the same bytes.

    Windows start at ``at`` in ``raw``. They are sorted by their first eight bytes; only ties
    go on. There, a window has one key for each cover place ahead of it: the distance, the
    rank of the string at that place, and the window's last eight bytes. Two windows are
    equal exactly if they share a key, and equal ones do at their common distance.
    """
    least = owner.copy()
    if not len(at):
        return least
    long = len(raw)
    eight = np.lib.stride_tricks.sliding_window_view(raw, 8)
    word = lambda p: np.ascontiguousarray(eight[p]).view(np.uint64).ravel()
    head = word(at)
    _, group, size = np.unique(head, return_inverse=True, return_counts=True)
    tied = np.flatnonzero(size[group] > 1)
    if not len(tied):
        return least
    at, group = at[tied], group[tied]
    tail = word(at + length - 8)
    reach = length - _PERIOD + 1  # from any of the first seven places, it stays in the window
    wanted = np.zeros(long, dtype=bool)
    cover = np.isin(np.arange(_PERIOD), _COVER)
    for k in range(_PERIOD):
        spot = at + k
        wanted[spot[cover[spot % _PERIOD]]] = True
    places = np.flatnonzero(wanted)
    strings = np.ascontiguousarray(
        np.lib.stride_tricks.sliding_window_view(raw, reach)[places]).view(f"V{reach}").ravel()
    rank = np.zeros(long, dtype=np.int64)
    rank[places] = np.unique(strings, return_inverse=True)[1]
    best = owner[tied].copy()
    for k in range(_PERIOD):
        here = np.flatnonzero(cover[(at + k) % _PERIOD])
        if not len(here):
            continue
        keys = np.stack([group[here], rank[at[here] + k], tail[here].view(np.int64)])
        order = np.lexsort(keys)
        sorted_ = keys[:, order]
        new = np.append(True, (sorted_[:, 1:] != sorted_[:, :-1]).any(axis=0))
        smallest = np.minimum.reduceat(best[here][order], np.flatnonzero(new))
        low = np.empty(len(here), dtype=np.int64)
        low[order] = smallest[np.cumsum(new) - 1]
        best[here] = np.minimum(best[here], low)
    least[tied] = best
    return least


def _spread(h: np.ndarray, blocks: int) -> np.ndarray:
    return (h % np.uint64(blocks)).astype(np.int64)


def _by_block(block: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(block, kind="stable")
    cuts = np.flatnonzero(np.diff(block[order])) + 1
    for part in np.split(order, cuts):
        if len(part):
            yield int(block[part[0]]), part


class _Outbox:
    """Arrays for each block, gathered over a task's input and written in few large rows."""

    def __init__(self, names: list[str]) -> None:
        self.names, self.size = names, 0
        self.held: dict[int, list[tuple]] = {}

    def add(self, block: int, *arrays: np.ndarray) -> None:
        self.held.setdefault(block, []).append(arrays)
        self.size += sum(a.nbytes for a in arrays)

    def full(self) -> bool:
        return self.size >= _HELD

    def rows(self) -> Iterator[pa.RecordBatch]:
        while self.held:
            block, parts = self.held.popitem()
            yield pa.RecordBatch.from_arrays(
                [pa.array([block]),
                 *[pa.array([_packed(np.concatenate(c))]) for c in zip(*parts)]], self.names)
        self.size = 0


def _packed(values: np.ndarray) -> bytes:
    """Compressed, with the number of bytes ahead; texts get far smaller than by the shuffle's own codec."""
    raw = values.tobytes()
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", compression_level=3).compress(raw, asbytes=True)


def _unpacked(held: bytes, kind) -> np.ndarray:
    size = int.from_bytes(held[:8], "little")
    return np.frombuffer(pa.decompress(held[8:], size, codec="zstd", asbytes=True) if size else b"", kind)


def _unpacked_size(held: bytes) -> int:
    return int.from_bytes(held[:8], "little")


def _shares(parts: list[tuple[bytes, ...]], kinds: tuple, limit: int) -> Iterator[list[np.ndarray]]:
    """The columns of a block's compressed rows, in shares of about ``limit`` bytes.

    The first column is a hash and decides the share, so equal ones come together; the last may
    hold many values for each of them, as told by the one before it.
    """
    runs = len(kinds) > 2
    shares = max(1, -(-sum(_unpacked_size(c) for part in parts for c in part) // limit))
    for share in range(shares):
        found = []
        for part in parts:
            h = _unpacked(part[0], kinds[0])
            mine = np.flatnonzero((h >> np.uint64(40)) % np.uint64(shares) == share)
            if not len(mine):
                continue
            rest = [_unpacked(c, k) for c, k in zip(part[1:], kinds[1:])]
            if len(mine) == len(h):
                found.append([h, *rest])
                continue
            if runs:
                size = rest[-2]
                rest[-1] = rest[-1][_runs((np.cumsum(size) - size)[mine], size[mine])]
            flat = len(rest) - runs
            found.append([h[mine], *(c[mine] for c in rest[:flat]), *rest[flat:]])
        if found:
            yield [np.concatenate(c) for c in zip(*found)]


def _shared(docs: DataFrame, length: int, gram: int, blocks: int, crowd: int, limit: int):
    """Bit table over anchors that two texts hold, and the sorted crowded anchors."""
    most = max(64, FILTER_BYTES * 8 // blocks)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Outbox(["block", "h", "n"])
        for b in batches:
            for raw, starts, rows, _ in _pieces(b.column(2).to_pylist(), length):
                h, _, _, piece = _anchors(raw, starts, length, gram)
                row = rows[piece]
                order = np.lexsort((row, h))
                h, row = h[order], row[order]
                new = np.append(True, h[1:] != h[:-1])[: len(h)]
                own = np.append(True, row[1:] != row[:-1])[: len(h)] | new
                first = np.flatnonzero(new)
                if not len(first):
                    continue
                n = np.minimum(np.add.reduceat(own, first, dtype=np.int64), 65535).astype("<u2")
                h = h[first]
                for block, part in _by_block(_spread(h, blocks)):
                    out.add(block, h[part], n[part])
                if out.full():
                    yield from out.rows()
        yield from out.rows()

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for b in batches:
            for block, h, n in zip(*(c.to_pylist() for c in b.columns)):
                held.setdefault(block, []).append((h, n))
        while held:
            block, parts = held.popitem()
            several = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))]
            for h, n in _shares(parts, (np.uint64, "<u2"), limit):
                keys, which = np.unique(h, return_inverse=True)
                total = np.bincount(which, weights=n).astype(np.int64)
                several.append((keys[total > 1], total[total > 1]))
            keys, total = (np.concatenate(c) for c in zip(*several))
            bits = 64
            while bits < 8 * len(keys) and bits * 2 <= most:
                bits *= 2
            table = np.zeros(bits, dtype=bool)
            table[(keys >> np.uint64(20)) % np.uint64(bits)] = True
            full = keys[total > crowd]
            yield pa.RecordBatch.from_arrays(
                [pa.array([block]), pa.array([np.packbits(table, bitorder="little").tobytes()]),
                 pa.array([full.tobytes()]), pa.array([total[total > crowd].tobytes()])],
                ["block", "table", "full", "counts"])

    rows = docs.mapInArrow(count, "block long, h binary, n binary").repartition(blocks, "block").mapInArrow(
        settle, "block long, table binary, full binary, counts binary")
    tables, full, counts = [b"\0" * 8] * blocks, [], []
    for r in rows.collect():  # one row a block, FILTER_BYTES together
        tables[r["block"]] = bytes(r["table"])
        full.append(np.frombuffer(r["full"], np.uint64))
        counts.append(np.frombuffer(r["counts"], np.int64))
    full, counts = (np.concatenate([np.zeros(0, t), *x]) for t, x in
                    ((np.uint64, full), (np.int64, counts)))
    full = full[np.argsort(-counts, kind="stable")[:MOST_CROWDED]]
    sizes = np.array([8 * len(t) for t in tables], dtype=np.int64)
    ends = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    return docs.sparkSession.sparkContext.broadcast(
        (np.frombuffer(b"".join(tables), np.uint8), ends, sizes, np.sort(full)))


_SPAN = "doc_id long, no int, start long, stop long"


def _span_batch(doc, no, start, stop) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(np.asarray(x).astype(t)) for x, t in
         ((doc, np.int64), (no, np.int32), (start, np.int64), (stop, np.int64))],
        ["doc_id", "no", "start", "stop"])


def merged(doc: np.ndarray, no: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, ...]:
    """Spans of the same rows as few as possible: those that touch or overlap become one."""
    if not len(doc):
        return doc, no, start, stop
    order = np.lexsort((start, no, doc))
    doc, no, start, stop = (x[order] for x in (doc, no, start, stop))
    new = np.append(True, (doc[1:] != doc[:-1]) | (no[1:] != no[:-1]))
    # one axis for all rows, each behind the one before, so that one running maximum serves
    reach = stop.max(initial=0) + 1
    shift = (np.cumsum(new) - 1) * reach
    end = np.maximum.accumulate(stop + shift)
    new[1:] |= start[1:] + shift[1:] > end[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1
    return doc[first], no[first], start[first], end[last] - shift[last]


def repeated_spans(docs: DataFrame, *, length: int = LENGTH, gram: int = GRAM,
                   crowd: int = CROWD, limit: int = _OPEN) -> DataFrame:
    """Byte spans that go, overlapping, as ``doc_id``, ``no``, ``start``, ``stop``.

    ``docs`` has doc_id (no nulls), no, and text as binary. ``no`` tells rows of one id apart.
    A block is unpacked ``limit`` bytes at a time, whatever it holds.
    """
    if not gram + 8 <= length or length < 2 * _PERIOD + 8:
        raise ValueError("windows are too short for the gram")
    blocks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounded_batches(docs.sparkSession)
    known = _shared(docs, length, gram, blocks, crowd, limit)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, ends, sizes, full = known.value
        box = _Outbox(["block", "h", "doc", "no", "start", "size", "bytes"])
        nothing = np.zeros(0, np.uint8)
        for b in batches:
            ids, nos = b.column(0).to_numpy(), b.column(1).to_numpy()
            for raw, starts, rows, places in _pieces(b.column(2).to_pylist(), length):
                h, first, last, piece = _anchors(raw, starts, length, gram)
                block = _spread(h, blocks)
                spot = ends[block] + ((h >> np.uint64(20)) % sizes[block].astype(np.uint64)
                                      ).astype(np.int64)
                go = (table[spot >> 3] >> (spot & 7).astype(np.uint8) & 1).astype(bool)
                h, first, last, piece = h[go], first[go], last[go], piece[go]
                sums = _sums(raw, 3)
                if len(full) and len(h):
                    # windows of crowded anchors, each by its own content
                    at = np.minimum(np.searchsorted(full, h), len(full) - 1)
                    many = full[at] == h
                    n = (last - first + 1)[many]
                    one = _runs(first[many], n)
                    h = np.concatenate([h[~many], _hash(sums, one, one + length)])
                    piece = np.concatenate([piece[~many], np.repeat(piece[many], n)])
                    first = np.concatenate([first[~many], one])
                    last = np.concatenate([last[~many], one])
                if not len(h):
                    continue
                row = rows[piece]
                doc, no = ids[row], nos[row]
                start = first - starts[piece] + places[piece]
                stop = last + length
                around = _hash(sums, first, stop)
                order = np.lexsort((doc, around, h))
                new = np.append(True, (h[order][1:] != h[order][:-1])
                                | (around[order][1:] != around[order][:-1]))
                least = np.minimum.reduceat(doc[order], np.flatnonzero(new))[np.cumsum(new) - 1]
                small = np.empty(len(h), dtype=bool)
                small[order] = doc[order] == least
                out = ~small
                if out.any():
                    whose, which, a, z = merged(doc[out], no[out], start[out], (start + stop - first)[out])
                    box.add(-1 - int(h[0] % np.uint64(blocks)), nothing, whose, which.astype(np.int32),
                            a, z - a, nothing)
                for block, part in _by_block(np.where(small, _spread(h, blocks), -1)):
                    if block < 0:
                        continue
                    size = stop[part] - first[part]
                    box.add(block, h[part], doc[part], no[part].astype(np.int32), start[part],
                            size, raw[_runs(first[part], size)])
                if box.full():
                    yield from box.rows()
        yield from box.rows()

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        kinds = (np.uint64, np.int64, np.int32, np.int64, np.int64, np.uint8)
        for b in batches:
            for block, *parts in zip(*(c.to_pylist() for c in b.columns)):
                if block < 0:
                    _, doc, no, start, size, _ = (_unpacked(p, k) for p, k in zip(parts, kinds))
                    yield _span_batch(doc, no, start, start + size)
                else:
                    held.setdefault(block, []).append(tuple(parts))
        while held:
            _, parts = held.popitem()
            for whole in _shares(parts, kinds, limit):
                # one part of the share at a time, by anchor
                cuts = max(1, len(whole[5]) // _PART)
                at_byte = np.cumsum(whole[4]) - whole[4]
                for cut in range(cuts):
                    mine = np.flatnonzero((whole[0] >> np.uint64(16)) % np.uint64(cuts) == cut)
                    if len(mine):
                        some = [x[mine] for x in whole[:5]]
                        raw = whole[5][_runs(at_byte[mine], some[4])]
                        yield from part_spans(*some, raw)

    def part_spans(h, doc, no, start, size, raw) -> Iterator[pa.RecordBatch]:
        from_ = np.cumsum(size) - size
        around = _hash(_sums(raw, 3), from_, from_ + size)
        order = np.lexsort((doc, around, h))
        h, doc, no, start, size, from_, around = (
            x[order] for x in (h, doc, no, start, size, from_, around))
        other = np.append(True, h[1:] != h[:-1])
        new = other | np.append(True, around[1:] != around[:-1])
        group = np.cumsum(new) - 1
        head = np.flatnonzero(new)
        least = doc[head]
        later = doc > least[group]
        if later.any():
            yield _span_batch(*merged(doc[later], no[later], start[later], (start + size)[later]))
        anchor = (np.cumsum(other) - 1)[head]
        several = np.bincount(anchor)[anchor] > 1
        chosen = np.flatnonzero(several)
        if not len(chosen):
            return
        n = size[head[chosen]] - length + 1
        at = _runs(from_[head[chosen]], n)
        owner = np.repeat(least[chosen], n)
        gone = window_minima(raw, at, owner, length) < owner
        # the smallest document's own places: all its rows of the group
        first_window = np.full(len(head), -1, dtype=np.int64)
        first_window[chosen] = np.cumsum(n) - n
        mine = np.flatnonzero(~later & several[group])
        m = size[mine] - length + 1
        which = _runs(first_window[group[mine]], m)
        row = np.repeat(mine, m)
        offset = np.arange(len(row)) - np.repeat(np.cumsum(m) - m, m)
        hit = gone[which]
        row, offset = row[hit], offset[hit]
        if not len(row):
            return
        begin = np.append(True, (row[1:] != row[:-1]) | (offset[1:] != offset[:-1] + 1))
        a = np.flatnonzero(begin)
        z = np.append(a[1:], len(row)) - 1
        yield _span_batch(doc[row[a]], no[row[a]], start[row[a]] + offset[a],
                          start[row[a]] + offset[z] + length)

    sent = docs.mapInArrow(
        send, "block long, h binary, doc binary, no binary, start binary, size binary, bytes binary")
    return sent.repartition(blocks, "block").mapInArrow(settle, _SPAN)


def remove_repeats(docs: DataFrame, **options) -> DataFrame:
    """For every row: ``doc_id``, ``text`` (what is left, as bytes), and what went.

    ``n_bytes``, ``n_removed``, ``n_spans`` (maximal removed runs). Texts are UTF-8; a null
    text counts as empty. Rows that share an id never remove bytes from each other; a row
    without an id is kept whole and removes nothing. Columns other than doc_id and text are
    ignored.
    """
    rows = texts(docs)
    twice = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter(
        "n > 1 AND doc_id IS NOT NULL").select("doc_id", F.lit(True).alias("again"))
    if twice.isEmpty():
        rows = rows.withColumn("no", F.lit(0))
    else:
        again = stage(twice, "twice")
        rows = rows.join(again, "doc_id", "left").select(
            "doc_id", "text", F.when(F.col("again"), F.xxhash64("text").bitwiseAND(F.lit(0x7FFFFFFF)))
            .otherwise(0).cast("int").alias("no"))
    rows = rows.select("doc_id", "no", F.col("text").cast("binary").alias("text"))
    spans = stage(repeated_spans(rows.filter("doc_id IS NOT NULL"), **options), "spans")
    per_doc = spans.groupBy("doc_id", "no").agg(
        F.collect_list("start").alias("starts"), F.collect_list("stop").alias("stops"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for text, starts, stops in zip(*(b.column(i).to_pylist() for i in (1, 2, 3))):
                text = text or b""
                if not starts:
                    out.append((text, len(text), 0, 0))
                    continue
                a, z = np.array(starts), np.array(stops)
                order = np.argsort(a, kind="stable")
                a, z = a[order], np.maximum.accumulate(z[order])
                new = np.append(True, a[1:] > z[:-1])
                begin = a[new]
                end = z[np.append(np.flatnonzero(new)[1:], len(a)) - 1]
                keep = np.ones(len(text), dtype=bool)
                keep[_runs(begin, end - begin)] = False
                left = np.frombuffer(text, np.uint8)[keep].tobytes()
                out.append((left, len(text), len(text) - len(left), len(begin)))
            cols = list(zip(*out)) if out else [()] * 4
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(cols[0], pa.binary()),
                 *[pa.array(c, pa.int64()) for c in cols[1:]]],
                ["doc_id", "text", "n_bytes", "n_removed", "n_spans"])

    # texts that lose nothing stay where they are; the table lets a few others pass to the join
    table = key_table(spans, "doc_id")

    def among(wanted: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            inside = in_table(table.value, b.column(0).to_numpy())
            yield b.select(["doc_id", "no", "text"]).filter(pa.array(inside == wanted))

    placed = rows.select(key_place("doc_id").alias("place"), "doc_id", "no", "text")
    kind = "doc_id long, no int, text binary"
    touched = placed.mapInArrow(functools.partial(among, True), kind)
    whole = placed.mapInArrow(functools.partial(among, False), kind)
    none = F.lit(0).cast("long")
    return touched.join(per_doc, ["doc_id", "no"], "left").select(
        "doc_id", "text", "starts", "stops").mapInArrow(
        cut, "doc_id long, text binary, n_bytes long, n_removed long, n_spans long"
    ).unionByName(whole.select(
        "doc_id", "text", F.octet_length("text").cast("long").alias("n_bytes"),
        none.alias("n_removed"), none.alias("n_spans")))


def repeat_digests(docs: DataFrame, **options) -> DataFrame:
    """The result with the hash of the bytes that are left in place of the bytes."""
    return remove_repeats(docs, **options).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("text", 256).alias("kept_sha256"))
