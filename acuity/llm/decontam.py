"""Benchmark decontamination by templates: numbers, names and units become typed slots.

A text becomes a row of tokens in which each number, each unit after a number, and each
capitalised word inside a sentence is a slot of its type; all else is the lower-cased word.
Windows of five tokens, at least three of them words, are hashed and joined with those of
the benchmark items. A question asked again with other numbers or names keeps its windows.

All places of the shared windows are kept, and those at the same distance from the item's own
are one aligned passage, in which each slot of the item meets one value. An item counts as
contained where any passage holds ``SIMILARITY`` of its windows, or ``RUN`` of them (thirteen
words on end). It also counts where the text as a whole holds ``SIMILARITY`` of its windows,
with words put in or left out between, if at most ``CONFLICTS`` of its slot values stand for
more than one value there.

An item whose windows hold fewer than ``LEAST`` words, as "What is the capital of France?", is
no template: other texts share it by chance. Such an item must stand in the text word by word,
numbers and names included, which is found by windows of all its tokens.

A bit table of fixed size, made from all benchmark windows, lets each task drop most windows
of the texts ahead of the join; it only drops windows that no item has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acuity.llm.common import column, stage, texts

WINDOW, LITERALS, SIMILARITY, RUN, CONFLICTS = 5, 3, 0.8, 9, 0.2
LEAST = 8
BITS = 1 << 24
# Units that make a slot after a number.
UNITS = frozenset(
    "mm cm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg lb lbs oz ton tons "
    "ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour "
    "hours day days week weeks month months year years percent dollar dollars euro euros cent cents "
    "usd eur gbp hz khz mhz ghz w kw mw v a j kj c f k degree degrees mph kmh".split()
)
_OTHER, _LETTER, _DIGIT, _END = range(4)
_NAME, _NUMBER, _UNIT = (np.uint64(xxhash.xxh64_intdigest(f"slot {k}")) for k in range(3))
_CHUNK = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1


def _byte_tables() -> tuple[np.ndarray, np.ndarray]:
    """Class and lower case of each byte; bytes beyond ASCII count as letters."""
    kind, lower = np.zeros(256, dtype=np.uint8), np.arange(256, dtype=np.uint64)
    kind[128:] = _LETTER
    for low, high in ((65, 91), (97, 123)):
        kind[low:high] = _LETTER
    kind[48:58] = _DIGIT
    kind[list(b".!?:\n")] = _END
    lower[65:91] += 32
    return kind, lower + 1


_KIND, _LOWER = _byte_tables()
_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2 ** 64, from 0 to n."""
    if len(_powers[0]) <= n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(n + 1, base, dtype=np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ h >> np.uint64(29)


def _tokens(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Tokens of texts laid end to end: first byte, last byte + 1, kind, hash, text number.

    ``starts`` has the first byte of each text. Runs of letters, numbers and sentence ends
    are tokens; a point or comma between digits belongs to the number. Latin letters are
    hashed in lower case.
    """
    kind, value = _KIND[raw], _LOWER[raw]
    left, right = raw[:-1], raw[1:]
    # two- and three-byte signs that are no letters, and capitals with accents
    for lead, follow in ((left == 0xC2, 1), ((left == 0xE2) & (right == 0x80), 2)):
        at = np.flatnonzero(lead)
        for k in range(follow + 1):
            kind[np.minimum(at + k, len(raw) - 1)] = _OTHER
    at = np.flatnonzero((left == 0xC3) & (right >= 0x80) & (right <= 0x9E)) + 1
    value[at] += 32
    inner = np.flatnonzero(((raw == 46) | (raw == 44))[1:-1]) + 1
    inner = inner[(kind[inner - 1] == _DIGIT) & (kind[inner + 1] == _DIGIT)]
    inner = inner[~np.isin(inner, starts) & ~np.isin(inner + 1, starts)]
    kind[inner] = _DIGIT
    cut = np.empty(len(raw), dtype=bool)
    cut[0], cut[1:] = True, kind[1:] != kind[:-1]
    cut[starts[starts < len(raw)]] = True
    first = np.flatnonzero(cut)
    last = np.append(first[1:], len(raw))
    keep = kind[first] != _OTHER
    first, last = first[keep], last[keep]
    forward, back = _power(len(raw))
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(value * forward[: len(raw)], out=sums[1:])
    hashes = _mix((sums[last] - sums[first]) * back[first])
    text = np.searchsorted(starts, first, side="right") - 1
    return first, last, kind[first], hashes, text


_UNITS = None


def _unit_hashes() -> np.ndarray:
    global _UNITS
    if _UNITS is None:
        raw = np.frombuffer(" ".join(sorted(UNITS)).encode(), dtype=np.uint8)
        _UNITS = np.sort(_tokens(raw, np.zeros(1, dtype=np.int64))[3])
    return _UNITS


def _wanted(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    low = hashes & np.uint64(BITS - 1)
    bit = table[(low >> np.uint64(3)).astype(np.int64)] >> (low & np.uint64(7)).astype(np.uint8)
    return (bit & 1).astype(bool)


def windows(raw: np.ndarray, starts: np.ndarray, table: np.ndarray | None = None
            ) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[list[str]], np.ndarray, np.ndarray]:
    """Text number, hash, place, slot values of windows; whether exact, whether the text's first.

    ``raw`` holds texts in UTF-8, laid end to end from ``starts`` on. ``table`` is the bit table
    of the wanted windows; all places of these are returned. Without it the texts are items, and
    the windows are those that each is to be found by.
    """
    none = np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), [], *[np.zeros(0, bool)] * 2
    if len(raw) < 2:
        return none
    first, last, kind, code, text = _tokens(raw, starts)
    if len(first) < WINDOW:
        return none
    fresh = np.append(True, text[1:] != text[:-1])
    before = np.append(_END, kind[:-1])
    before[fresh] = _END
    number = kind == _DIGIT
    after = np.flatnonzero((before == _DIGIT) & (kind == _LETTER))
    unit = after[np.isin(code[after], _unit_hashes())]
    head, second = raw[first], raw[np.minimum(first + 1, len(raw) - 1)]
    capital = ((head >= 65) & (head <= 90)) | ((head == 0xC3) & (second >= 0x80) & (second <= 0x9E))
    small = ((second >= 97) & (second <= 122)) | (second >= 128)
    name = capital & small & (last - first > 1) & (kind == _LETTER) & (before != _END)
    plain = code.copy()
    code[number], code[name], code[unit] = _NUMBER, _NAME, _UNIT
    slot = number | name
    slot[unit] = True
    kept = np.flatnonzero(kind != _END)
    code, plain, slot, text = code[kept], plain[kept], slot[kept], text[kept]
    n = len(code) - WINDOW + 1
    if n < 1:
        return none
    mixed, whole = np.zeros(n, dtype=np.uint64), np.full(n, _BASE, dtype=np.uint64)
    words = np.zeros(n, dtype=np.int8)
    for i in range(WINDOW):
        mixed = _mix((mixed ^ code[i : i + n]) * np.uint64(_BASE))
        whole = _mix((whole ^ plain[i : i + n]) * np.uint64(_BASE))
        words += ~slot[i : i + n]
    inside = text[:n] == text[WINDOW - 1 :]
    good = (words >= LITERALS) & inside
    ahead = np.searchsorted(text, text[:n], side="left")
    if table is None:
        # whether an item's first word is a name depends on where it was pasted in
        good &= np.arange(n) > ahead
        seen = np.zeros(len(code), dtype=bool)
        for i in range(WINDOW):
            seen[i : i + n] |= good
        short = np.bincount(text[seen & ~slot], minlength=text[-1] + 1)[text[:n]] < LEAST
        good, exact = good & ~short, inside & short
    else:
        good, exact = (ok & _wanted(table, h) for ok, h in ((good, mixed), (inside, whole)))
    place = np.concatenate([np.flatnonzero(good), np.flatnonzero(exact)])
    word = np.repeat([False, True], [good.sum(), exact.sum()])
    mixed = np.where(word, whole[place], mixed[place])
    order = np.lexsort((place, mixed, text[place]))
    place, word, mixed = place[order], word[order], mixed[order]
    new = np.append(True, (mixed[1:] != mixed[:-1]) | (text[place][1:] != text[place][:-1]))[: len(place)]
    if table is None:
        keep = new | word
        place, word, mixed, new = place[keep], word[keep], mixed[keep], new[keep]
    slots = [
        [raw[first[kept[j]] : last[kept[j]]].tobytes().decode("utf-8", "replace")
         for j in range(p, p + WINDOW) if slot[j] and not w]
        for p, w in zip(place.tolist(), word.tolist())
    ]
    return text[place], mixed, (place - ahead[place]).astype(np.int64), slots, word, new


def _chunks(batch: list[bytes | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Texts in groups of about a megabyte: number of the first, bytes, starts."""
    begin, held, size = 0, [], 0
    for i, text in enumerate(batch):
        held.append(text or b"")
        size += len(held[-1])
        if size >= _CHUNK or i == len(batch) - 1:
            starts = np.concatenate([[0], np.cumsum([len(t) for t in held[:-1]])]).astype(np.int64)
            yield begin, np.frombuffer(b"".join(held), dtype=np.uint8), starts
            begin, held, size = i + 1, [], 0


def _window_rows(rows: DataFrame, id_col: str, table=None) -> DataFrame:
    """The rows of ``windows`` and their number in the text; ``rows`` has the id and ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if table is None else np.frombuffer(table.value, dtype=np.uint8)
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            known = np.asarray(batch.column(0).is_valid())
            for begin, raw, starts in _chunks(batch.column(1).to_pylist()):
                text, hashes, places, slots, exact, new = windows(raw, starts, bits)
                if not len(text):
                    continue
                sizes = np.bincount(text)[text]
                at = begin + text
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.where(known[at], keys[at], 0).astype(np.int64), mask=~known[at]),
                     pa.array(hashes.view(np.int64)), pa.array(places),
                     pa.array(slots, pa.list_(pa.string())), pa.array(sizes.astype(np.int64)),
                     pa.array(exact), pa.array(new)],
                    [id_col, "w", "place", "slots", "n_windows", "exact", "new"],
                )

    rows = rows.withColumn("text", F.col("text").cast("binary"))
    return rows.mapInArrow(
        run, f"{id_col} long, w long, place long, slots array<string>, n_windows long, "
        "exact boolean, new boolean"
    )


def _bit_table(items: DataFrame):
    """The bit table as a broadcast: 2 MB, whatever the benchmark's size."""
    spot = f"w & {BITS - 1}"
    cells = items.groupBy(F.expr(f"shiftright({spot}, 5)").alias("cell")).agg(
        F.expr(f"bit_or(shiftleft(1L, int({spot} & 31)))").alias("b")
    )
    table = np.zeros(BITS // 32, dtype="<u4")
    for cell, bits in cells.collect():  # at most BITS / 32 rows
        table[cell] = bits
    return items.sparkSession.sparkContext.broadcast(table.tobytes())


def find_leaks(docs: DataFrame, benchmark: DataFrame, *, similarity: float = SIMILARITY,
               run: int = RUN, conflicts: float = CONFLICTS) -> DataFrame:
    """One row per text and benchmark item that it contains.

    ``doc_id``, ``item_id``, ``n_windows`` shared, ``coverage`` of the item's windows,
    ``n_slots`` (slot values of the item met, 0 for an item found word by word) and ``kind``:
    verbatim where all slot values of a passage are the same, else reparameterised. Null or empty texts and texts or items of fewer than
    five tokens have no windows and are in no row. Rows that share an id are taken as one
    text; a null id counts as one id. Columns other than the ids and texts are ignored.
    """
    source = benchmark.select(
        column(benchmark, "item_id").cast("long").alias("item_id"),
        column(benchmark, "text").cast("string").alias("text"),
    )
    items = stage(_window_rows(source, "item_id"), "items")
    hits = stage(_window_rows(texts(docs), "doc_id", _bit_table(items)), "windows")
    met = hits.select("doc_id", "w", "place", "slots", "exact", "new").join(
        items.select("item_id", "w", "exact", F.col("place").alias("item_place"),
                     F.col("slots").alias("item_slots"), F.col("n_windows").alias("size")),
        ["w", "exact"],
    )
    # a slot stands in up to five windows; sets hold each pair of values once
    values = lambda c: F.array_distinct(F.flatten(F.collect_set(c)))
    zipped = F.arrays_zip("item_slots", "slots")
    equal = lambda c: F.forall(c, lambda s: F.lower(s["item_slots"]) == F.lower(s["slots"]))
    passages = met.groupBy(
        "doc_id", "item_id", "exact", (F.col("place") - F.col("item_place")).alias("at")
    ).agg(
        F.size(F.collect_set("item_place")).alias("n"),
        F.max("size").alias("size"),
        F.collect_set("w").alias("ws"),
        values(zipped).alias("slots"),
        values(F.when(F.col("new"), zipped)).alias("first"),
    ).withColumn("fits", F.when(F.col("exact"), F.col("n") >= F.col("size")).otherwise(
        (F.col("n") >= similarity * F.col("size")) | (F.col("n") >= run)
    )).withColumn("same", F.col("fits") & equal("slots"))
    pairs = passages.groupBy("doc_id", "item_id", "exact").agg(
        F.size(values("ws")).cast("long").alias("shared"), F.max("size").alias("size"),
        values("first").alias("slots"), F.max("fits").alias("fits"), F.max("same").alias("same"),
    ).select(
        "doc_id", "item_id", "exact", "fits", F.least("shared", "size").alias("n_windows"),
        F.when(F.col("exact") & F.col("fits"), 1.0).otherwise(
            F.least(F.col("shared") / F.col("size"), F.lit(1.0))).alias("coverage"), "slots",
        F.size(F.array_distinct(F.transform("slots", lambda s: s["item_slots"]))).alias("n_slots"),
        (F.col("same") | equal("slots")).alias("same"),
    )
    # values of the item that stand for more than one value of the text
    split = F.size("slots") - F.col("n_slots")
    kept = pairs.filter(F.col("fits") | (
        ~F.col("exact") & (F.col("coverage") >= similarity) & (split <= conflicts * F.col("n_slots"))
    ))
    return kept.select(
        "doc_id", "item_id", "n_windows", F.round("coverage", 4).alias("coverage"),
        F.col("n_slots").cast("long").alias("n_slots"),
        F.when(F.col("same"), "verbatim").otherwise("reparameterised").alias("kind"),
    )


def drop_leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the texts that contain a benchmark item; rows without a doc_id stay."""
    leaks = stage(find_leaks(docs, benchmark, **options).select("doc_id").distinct(), "leaks")
    return docs.join(leaks.filter("doc_id IS NOT NULL"), "doc_id", "left_anti").select(*docs.columns)
