"""SentencePiece merge segmentation with seeded dropout, and its exact inverse.

A text is escaped as the vocabulary expects (one blank in front, blanks as U+2581) and cut
into units that no piece reaches across: before blanks, and between letters, digits and other
signs. Inside a unit an agenda takes the best-ranked merge first, ties from the left. With
dropout, a merge taken from the agenda is skipped for good when a hash of (seed, variant,
unit, place, pair) falls below the rate. The hash alone decides: the same seed gives the same
pieces on any cluster, another seed others. A text has one of ``VARIANTS`` variants by a hash
of its content, so that a word is cut in several ways across texts.

Whatever the merges, the pieces spell the text: signs without a piece, and the escape sign
itself, are written as byte pieces. ``decode`` therefore returns every text unchanged.

Texts are taken in chunks of about two million characters. The distinct units of a chunk are
merged side by side, one agenda step of every unit at a time, as array operations.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acuity.llm.common import texts

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
DROPOUT, SEED, VARIANTS = 0.1, 42, 4
_CHUNK, _LONG, _NONE = 1 << 19, 256, 1 << 30
_BASE = 0x9E3779B97F4A7C15
_CODES = 0x110000


def sign_class(sign: str) -> int:
    return 1 if sign.isalpha() else 2 if sign.isdecimal() else 3


@dataclass
class Vocabulary:
    """Pieces of a model file as arrays.

    ``symbol`` has the piece of each code point, or ``size`` + code point where there is none;
    ``kind`` its class; ``keys``, ``ranks`` and ``merged`` are a hash table over pairs.
    """

    size: int
    symbol: np.ndarray
    kind: np.ndarray
    keys: np.ndarray
    ranks: np.ndarray
    merged: np.ndarray
    spelling: np.ndarray
    spelling_at: np.ndarray
    byte_ids: np.ndarray
    ids: dict[str, int]
    rank: dict[str, int]

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        pieces = [model.id_to_piece(i) for i in range(size)]
        plain = [i for i in range(size) if pieces[i] and not (
            model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
        order = sorted(plain, key=lambda i: (-model.get_score(i), i))
        ids = {pieces[i]: i for i in plain}
        rank = {pieces[i]: r for r, i in enumerate(order)}

        kind = np.fromiter((sign_class(chr(c)) for c in range(_CODES)), np.int8, _CODES)
        kind[ord(SPACE)] = 3
        if any(len({sign_class(c) for c in p.lstrip(SPACE)}) > 1 for p in ids):
            kind[:] = 3  # a piece that mixes classes: cut at blanks alone
        kind[ord(" ")] = 0
        symbol = np.arange(size, size + _CODES, dtype=np.int32)
        for p, i in ids.items():
            if len(p) == 1 and p != SPACE:
                symbol[ord(p)] = i
        symbol[ord(" ")] = ids[SPACE]

        slots = 1 << 20
        while slots < 4 * sum(map(len, ids)):
            slots *= 2
        keys = np.full(slots, -1, dtype=np.int64)
        ranks = np.full(slots, _NONE, dtype=np.int64)
        merged = np.zeros(slots, dtype=np.int32)
        for p, i in ids.items():
            for cut in range(1, len(p)):
                a, b = ids.get(p[:cut]), ids.get(p[cut:])
                if a is not None and b is not None:
                    key = a * size + b
                    at = _slot(key, slots)
                    while keys[at] >= 0:
                        at = (at + 1) % slots
                    keys[at], ranks[at], merged[at] = key, rank[p], i
        byte_ids = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        spelt = [b""] * size
        for i in plain:
            spelt[i] = pieces[i].replace(SPACE, " ").encode()
        for b, i in enumerate(byte_ids):
            spelt[i] = bytes([b])
        ends = np.cumsum([0, *map(len, spelt)]).astype(np.int64)
        return cls(size, symbol, kind, keys, ranks, merged,
                   np.frombuffer(b"".join(spelt), np.uint8), ends, byte_ids, ids, rank)

    def pair(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged piece of each pair of symbols; no rank where they do not merge."""
        slots = len(self.keys)
        rank = np.full(len(a), _NONE, dtype=np.int64)
        piece = np.zeros(len(a), dtype=np.int32)
        open_ = np.flatnonzero((a < self.size) & (b < self.size))
        key = a[open_].astype(np.int64) * self.size + b[open_]
        at = _slots(key, slots)
        while len(open_):
            found = self.keys[at] == key
            rank[open_[found]], piece[open_[found]] = self.ranks[at[found]], self.merged[at[found]]
            go = ~found & (self.keys[at] >= 0)
            open_, key, at = open_[go], key[go], (at[go] + 1) % slots
        return rank, piece


def _slot(key: int, slots: int) -> int:
    return ((key * _BASE & (1 << 64) - 1) >> 40) % slots


def _slots(key: np.ndarray, slots: int) -> np.ndarray:
    mixed = key.astype(np.uint64) * np.uint64(_BASE) >> np.uint64(40)
    return (mixed % np.uint64(slots)).astype(np.int64)


_loaded: dict[str, Vocabulary] = {}


def vocabulary(path: str = MODEL) -> Vocabulary:
    """The model file's vocabulary, read once in each process."""
    if path not in _loaded:
        _loaded[path] = Vocabulary.load(path)
    return _loaded[path]


def skips(key, start, split, end, below: int):
    """Whether the merge of [start, split) and [split, end) in a unit is dropped.

    Takes arrays or numbers; ``key`` stands for seed, variant and unit.
    """
    mask = np.uint64(0xFFFFFFFF)
    h = np.asarray(key, dtype=np.uint64)
    for part, by in ((start, 0x9E3779B1), (split, 0x85EBCA77), (end, 0xC2B2AE3D)):
        h = (h ^ np.asarray(part, dtype=np.uint64) * np.uint64(by)) & mask
        h = (h ^ h >> np.uint64(15)) * np.uint64(0x2C1B3C6D) & mask
    h = (h ^ h >> np.uint64(12)) * np.uint64(0x297A2D39) & mask
    return (h ^ h >> np.uint64(15)) < np.uint64(below)


def merge_long(symbols: list[int], vocab: Vocabulary, key: int, below: int) -> list[int]:
    """Pieces of one unit of any length, from a heap, in n log n steps."""
    n = len(symbols)
    piece, end, before = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1))
    heap: list[tuple[int, int, int, int, int]] = []

    def push(lefts: list[int]) -> None:
        rights = [end[a] for a in lefts]
        rank, into = vocab.pair(np.array([piece[a] for a in lefts], np.int32),
                                np.array([piece[b] for b in rights], np.int32))
        for a, b, r, i in zip(lefts, rights, rank.tolist(), into.tolist()):
            if r < _NONE:
                heapq.heappush(heap, (r, a, b, end[b], i))

    push(list(range(n - 1)))
    while heap:
        _, a, b, stop, into = heapq.heappop(heap)
        if end[a] != b or end[b] != stop or (below and skips(key, a, b, stop, below)):
            continue
        piece[a], end[a], end[b] = into, stop, 0
        if stop < n:
            before[stop] = a
        push([x for x in (before[a], a) if x >= 0 and end[x] < n])
    out, at = [], 0
    while at < n:
        out.append(piece[at])
        at = end[at]
    return out


def _merge_units(symbol: np.ndarray, lengths: np.ndarray, keys: np.ndarray, vocab: Vocabulary,
                 below: int) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of units laid end to end, and the number of pieces of each unit."""
    unit = np.repeat(np.arange(len(lengths)), lengths)
    offset = np.arange(len(symbol)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    rank = np.full(len(symbol), _NONE, dtype=np.int64)
    into = np.zeros(len(symbol), dtype=np.int32)
    same = np.flatnonzero(unit[1:] == unit[:-1])
    rank[same], into[same] = vocab.pair(symbol[same], symbol[same + 1])
    full, done = lengths.copy(), []
    while len(symbol):
        starts = np.flatnonzero(np.append(True, unit[1:] != unit[:-1]))
        counts = np.diff(np.append(starts, len(symbol)))
        best = np.minimum.reduceat(rank << 32 | np.arange(len(symbol)), starts)
        ready = best >> 32 >= _NONE
        if ready.any():
            out = np.repeat(ready, counts)
            done.append((unit[out], symbol[out]))
            keep = ~out
            symbol, unit, offset, rank, into = (x[keep] for x in (symbol, unit, offset, rank, into))
            if not len(symbol):
                break
            shift = np.cumsum(out)[np.flatnonzero(keep)]
            at = (best[~ready] & 0xFFFFFFFF)
            at = at - shift[np.searchsorted(np.flatnonzero(keep), at)]
        else:
            at = best & 0xFFFFFFFF
        of = unit[at]
        if below:
            after = np.minimum(at + 2, len(symbol) - 1)
            stop = np.where((at + 2 < len(symbol)) & (unit[after] == of), offset[after], full[of])
            drop = skips(keys[of], offset[at], offset[at + 1], stop, below)
            rank[at[drop]] = _NONE
            at = at[~drop]
        symbol[at] = into[at]
        keep = np.ones(len(symbol), dtype=bool)
        keep[at + 1] = False
        symbol, unit, offset, rank, into = (x[keep] for x in (symbol, unit, offset, rank, into))
        at = at - np.arange(len(at))  # one sign fewer for each merge further left
        for left in (at, at[at > 0] - 1):
            right = np.minimum(left + 1, len(symbol) - 1)
            whole = (left + 1 < len(symbol)) & (unit[left] == unit[right])
            rank[left[~whole]] = _NONE
            left, right = left[whole], right[whole]
            rank[left], into[left] = vocab.pair(symbol[left], symbol[right])
    units = np.concatenate([d[0] for d in done])
    order = np.argsort(units, kind="stable")
    return (np.concatenate([d[1] for d in done])[order],
            np.bincount(units, minlength=len(lengths)))


def _spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indexes of runs laid end to end."""
    shift = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
    return np.arange(len(shift)) + shift


def _as_bytes(pieces: np.ndarray, counts: np.ndarray, vocab: Vocabulary
              ) -> tuple[np.ndarray, np.ndarray]:
    """Signs without a piece replaced by their byte pieces."""
    odd = pieces >= vocab.size
    if not odd.any():
        return pieces, counts
    codes, which = np.unique(pieces[odd] - vocab.size, return_inverse=True)
    spelt = [vocab.byte_ids[list(chr(c).encode("utf-8", "replace"))] for c in codes]
    sizes = np.ones(len(pieces), dtype=np.int64)
    sizes[odd] = np.array([len(s) for s in spelt])[which]
    out = np.repeat(pieces, sizes)
    at = np.cumsum(sizes) - sizes
    flat, ends = np.concatenate(spelt), np.cumsum([0, *map(len, spelt)])
    out[_spans(at[odd], sizes[odd])] = flat[_spans(ends[:-1][which], sizes[odd])]
    owner = np.repeat(np.arange(len(counts)), counts)
    return out, np.bincount(owner, weights=sizes, minlength=len(counts)).astype(np.int64)


def encode_batch(batch: list[str], vocab: Vocabulary, *, dropout: float = DROPOUT,
                 seed: int = SEED, variants: int = VARIANTS) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of the texts laid end to end, and the number of ids of each text."""
    n_ids = np.zeros(len(batch), dtype=np.int64)
    full = [i for i, t in enumerate(batch) if t]
    if not full:
        return np.zeros(0, dtype=np.int32), n_ids
    code = np.frombuffer("".join([f" {batch[i]}" for i in full]).encode("utf-32-le"), np.uint32)
    sizes = np.array([len(batch[i]) + 1 for i in full])
    begins = np.cumsum(sizes) - sizes
    kind = vocab.kind[code]
    cut = np.empty(len(code), dtype=bool)
    cut[0] = True
    # before a run of blanks, and where the class changes unless blanks stand in front
    cut[1:] = (kind[1:] != kind[:-1]) & (kind[:-1] != 0)
    cut[begins] = True
    first = np.flatnonzero(cut)
    lengths = np.diff(np.append(first, len(code)))
    text = np.repeat(np.arange(len(full)), np.add.reduceat(cut, begins, dtype=np.int64))

    power = np.full(len(code), _BASE, dtype=np.uint64)
    power[0] = 1
    forward = np.multiply.accumulate(power)
    power[1:] = pow(_BASE, -1, 1 << 64)
    back = np.multiply.accumulate(power)
    value = (code.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    sums = np.zeros(len(code) + 1, dtype=np.uint64)
    np.cumsum((value ^ value >> np.uint64(31)) * forward, out=sums[1:])
    unit = (sums[first + lengths] - sums[first]) * back[first]
    below = int(dropout * (1 << 32))
    if below:
        whole = (sums[begins + sizes] - sums[begins]) * back[begins]
        whole = (whole ^ np.uint64(seed & (1 << 64) - 1)) * np.uint64(0xD6E8FEB86659FD93)
        variant = (whole >> np.uint64(33)) % np.uint64(variants)
        unit ^= variant[text] * np.uint64(0xC2B2AE3D27D4EB4F)
    unit ^= np.uint64(seed * _BASE & (1 << 64) - 1)
    unit = (unit ^ unit >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93) ^ lengths.astype(np.uint64)

    keys, where, which = np.unique(unit, return_index=True, return_inverse=True)
    size = lengths[where]
    short = size <= _LONG
    symbols = vocab.symbol[code[_spans(first[where][short], size[short])]]
    got, got_n = (np.zeros(0, np.int32), np.zeros(0, np.int64)) if not short.any() else (
        _merge_units(symbols, size[short], keys[short] & np.uint64(0xFFFFFFFF), vocab, below))
    pieces, counts = [got], np.zeros(len(keys), dtype=np.int64)
    counts[short] = got_n
    base = np.zeros(len(keys), dtype=np.int64)
    base[short] = np.cumsum(got_n) - got_n
    total = len(got)
    for i in np.flatnonzero(~short):
        at = first[where[i]]
        one = merge_long(vocab.symbol[code[at : at + size[i]]].tolist(), vocab,
                         int(keys[i]) & 0xFFFFFFFF, below)
        pieces.append(np.array(one, dtype=np.int32))
        base[i], counts[i], total = total, len(one), total + len(one)
    flat = np.concatenate(pieces)
    order = np.argsort(base, kind="stable")  # units without pieces do not occur
    flat, spelt = _as_bytes(flat, counts[order], vocab)
    counts[order] = spelt
    base[order] = np.cumsum(spelt) - spelt
    ids = flat[_spans(base[which], counts[which])]
    n_ids[full] = np.bincount(text, weights=counts[which], minlength=len(full)).astype(np.int64)
    return ids, n_ids


def decode_batch(ids: np.ndarray, n_ids: np.ndarray, vocab: Vocabulary) -> list[bytes]:
    """The UTF-8 texts that the ids spell, without the blank in front."""
    sizes = np.diff(vocab.spelling_at)[ids]
    out = vocab.spelling[_spans(vocab.spelling_at[ids], sizes)].tobytes()
    ends = np.append(0, np.cumsum(sizes))[np.append(0, np.cumsum(n_ids))].tolist()
    return [out[a + 1 : b] for a, b in zip(ends, ends[1:])]


def _groups(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about one chunk together."""
    begin = total = 0
    for i, size in enumerate(sizes):
        total += size
        if total >= _CHUNK:
            yield begin, i + 1
            begin, total = i + 1, 0
    if begin < len(sizes):
        yield begin, len(sizes)


def encode(docs: DataFrame, *, model: str = MODEL, dropout: float = DROPOUT, seed: int = SEED,
           variants: int = VARIANTS) -> DataFrame:
    """``doc_id`` and ``ids`` of every row; a null or empty text has no ids.

    Rows may repeat and doc_id may be null. Columns other than doc_id and text are ignored.
    ``model`` is a path that every executor can read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(model)
        for batch in batches:
            rows = batch.column(1).to_pylist()
            for a, b in _groups([len(t) for t in rows]):
                ids, n = encode_batch(rows[a:b], vocab, dropout=dropout, seed=seed,
                                      variants=variants)
                offsets = pa.array(np.append(0, np.cumsum(n)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a),
                     pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32()))],
                    ["doc_id", "ids"],
                )

    return texts(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, *, model: str = MODEL) -> DataFrame:
    """``doc_id``, ``ids`` and the ``text`` they spell; null ids spell the empty text.

    Bytes that are no UTF-8, which ids from elsewhere may spell, become replacement signs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(model)
        for batch in batches:
            lists = batch.column(1)
            n = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for a, b in _groups((4 * n).tolist()):
                part = lists.slice(a, b - a)
                spelt = decode_batch(part.flatten().to_numpy(zero_copy_only=False), n[a:b], vocab)
                try:
                    text = pa.array(spelt, pa.binary()).cast(pa.string())
                except pa.ArrowInvalid:
                    text = pa.array([s.decode("utf-8", "replace") for s in spelt], pa.string())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), part, text], ["doc_id", "ids", "text"]
                )

    return encoded.select("doc_id", "ids").mapInArrow(
        run, "doc_id long, ids array<int>, text string"
    )


def encode_checked(docs: DataFrame, *, model: str = MODEL, dropout: float = DROPOUT,
                   seed: int = SEED, variants: int = VARIANTS) -> DataFrame:
    """``doc_id``, ``ids`` and ``lossless``: whether decoding the ids gave the text's own bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(model)
        for batch in batches:
            rows = batch.column(1).to_pylist()
            for a, b in _groups([len(t) for t in rows]):
                ids, n = encode_batch(rows[a:b], vocab, dropout=dropout, seed=seed,
                                      variants=variants)
                spelt = decode_batch(ids, n, vocab)
                offsets = pa.array(np.append(0, np.cumsum(n)).astype(np.int32))
                same = [s == t.encode() for s, t in zip(spelt, rows[a:b])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a),
                     pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32())),
                     pa.array(same)], ["doc_id", "ids", "lossless"])

    return texts(docs).mapInArrow(run, "doc_id long, ids array<int>, lossless boolean")


def token_digests(docs: DataFrame, **options) -> DataFrame:
    """Token count, a hash of the ids, and a hash of the decoded text, which is the text's own."""
    model = options.get("model", MODEL)
    return decode(encode(docs, **options), model=model).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.xxhash64("ids").alias("ids_hash"),
        F.sha2("text", 256).alias("text_sha256"),
    )
