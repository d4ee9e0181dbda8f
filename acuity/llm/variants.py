"""Spelling variants: words that differ by one edit, grouped under their more frequent form.

Words are the letter runs of whole texts. A pair of words is *near* if one insertion, deletion
or replacement of a code point makes one the other. Near pairs are found by dense
prefix-suffix tiling: words in padded code-point matrices are compared block against block,
column by column from the left and from the right, and a common prefix plus a common suffix
that reach the longer length minus one mean a single edit.

Which blocks meet follows from where the edit can lie. For a pair whose shorter word has length
L, the edit lies in a window [s, e) of its places: all before s and all from e on is common.
Words are dealt to groups by (L, s, e, common parts), at first with the two halves as windows.
A group of more than ``CROWD`` words halves its window again, which fixes more of the word, so
groups shrink until a window is one place wide: then at most the alphabet, or its square for
the longer words, is left in one. A pair counts only in the group whose window holds its first
difference, so none is counted twice and none is lost. Only counts and the best partner of a
word leave a group, never its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acuity.llm.common import stage, texts

LETTERS, LEAST_LENGTH, LEAST_COUNT = "[A-Za-zÀ-ÿ]+", 5, 3
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words in a group before its window is halved; only the amount of work depends on it.
CROWD = 2_048
#: Rows of a block, and word pairs compared at once.
BLOCK, AT_ONCE = 64, 1 << 19


def runs_of(docs: DataFrame, *, every: int = 97) -> DataFrame:
    """``word`` per letter run of every text, lower-cased in A-Z, some with a code point dropped.

    With h the crc32 of ``<doc_id>:<run>``, a run whose h ``every`` divides loses its code point
    h modulo its length. A null doc_id stands as the empty text.
    """
    runs = texts(docs).select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"),
        F.explode(F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(LETTERS), F.lit(0)))
        .alias("run"),
    ).withColumn("h", F.crc32(F.concat_ws(":", "doc", "run")))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return runs.select(F.when(F.col("h") % every == 0, cut).otherwise(F.col("run")).alias("word"))


def vocabulary(docs: DataFrame, *, least_length: int = LEAST_LENGTH,
               least_count: int = LEAST_COUNT) -> DataFrame:
    """``word`` and its number of occurrences ``n``; counts combine before the shuffle."""
    return (
        runs_of(docs).filter(F.length("word") >= least_length)
        .groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_count)
    )


def _windows(words: DataFrame, windows: Column) -> DataFrame:
    """One row per word and window, with the group's key: a hash of the parts outside."""
    rows = words.select("word", "n", F.explode(windows).alias("at")).select("word", "n", "at.*")
    behind = F.length("word") - (F.col("short") - F.col("until"))
    return rows.withColumn("key", F.xxhash64(
        F.substring("word", F.lit(1), F.col("since")),
        F.substring("word", behind + 1, F.length("word")),
    ))


def _halves(short: str, since: str, until: str) -> list[Column]:
    mid = F.expr(f"int(({since} + {until}) / 2)")
    return [
        F.struct(F.expr(short).cast("int").alias("short"), a.alias("since"), b.alias("until"))
        for a, b in ((F.expr(since).cast("int"), mid), (mid, F.expr(until).cast("int")))
    ]


def groups_of(words: DataFrame, *, crowd: int = CROWD) -> DataFrame:
    """Words with the groups (``short``, ``since``, ``until``, ``key``) they take part in.

    A word of length l is the shorter or an equal one in groups with short = l, and the
    longer one in those with short = l - 1.
    """
    group = ["short", "since", "until", "key"]
    open_ = _windows(words, F.array(*_halves("length(word)", "0", "length(word)"),
                                    *_halves("length(word) - 1", "0", "length(word) - 1")))
    done = None
    while True:
        hot = stage(
            open_.groupBy(*group).agg(F.count(F.lit(1)).alias("rows"))
            .filter((F.col("rows") > crowd) & (F.col("until") - F.col("since") > 1))
            .select(*group), "crowded")
        if hot.isEmpty():
            return open_ if done is None else done.unionByName(open_)
        calm = open_.join(hot, group, "left_anti").select(*open_.columns)
        done = calm if done is None else done.unionByName(calm)
        again = open_.join(hot, group, "left_semi")
        open_ = stage(_windows(
            again.withColumn("_w", F.array(*_halves("short", "since", "until")))
            .select("word", "n", "_w"), F.col("_w")), "halved")


def matrices(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points from the left and from the right, 0 as padding, and the lengths."""
    size = np.array([len(w) for w in words])
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    if points.max(initial=0) < 256:
        points = points.astype(np.uint8)
    left, right = (np.zeros((len(words), size.max(initial=1)), points.dtype) for _ in range(2))
    inside = np.arange(left.shape[1])[None, :] < size[:, None]
    left[inside] = points
    start = np.cumsum(size) - size
    back = (start + size - 1)[:, None] - np.arange(left.shape[1])[None, :]
    right[inside] = points[back[inside]]
    return left, right, size


def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common start for each row of each block in ``a`` with each in ``b``.

    ``a`` and ``b`` are (blocks, rows, columns); padding counts as common, so the caller
    takes the smaller of this and the lengths.
    """
    shape = (a.shape[0], a.shape[1], b.shape[1])
    alive, total = np.ones(shape, bool), np.zeros(shape, np.int32)
    for c in range(a.shape[2]):
        alive &= a[:, :, None, c] == b[:, None, :, c]
        if not alive.any():
            break
        total += alive
    return total


def block_pairs(sizes: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Batches of (block length, starts of first blocks, starts of second blocks).

    Groups of up to ``BLOCK`` rows are one block, of the next power of two; larger ones are
    cut into blocks, each of which meets itself and all later ones.
    """
    width = 2
    while width < BLOCK:
        own = starts[(sizes <= width) & (sizes > width // 2)]
        if len(own):
            yield width, own, own
        width *= 2
    for begin, size in zip(starts[sizes > BLOCK // 2], sizes[sizes > BLOCK // 2]):
        tops = np.arange(begin, begin + size, BLOCK)
        for i, top in enumerate(tops):
            yield BLOCK, np.full(len(tops) - i, top), tops[i:]


def near_pairs(left: np.ndarray, right: np.ndarray, size: np.ndarray, group: np.ndarray,
               short: np.ndarray, since: np.ndarray, until: np.ndarray
               ) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of near pairs, over rows in order of their group's number."""
    begin = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    sizes = np.diff(np.r_[begin, len(group)])
    found: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64),) * 2]
    for width, firsts, seconds in block_pairs(sizes[sizes > 1], begin[sizes > 1]):
        step = max(1, AT_ONCE // (width * width))
        for k in range(0, len(firsts), step):
            f, s = firsts[k : k + step], seconds[k : k + step]
            i = f[:, None] + np.arange(width)
            j = s[:, None] + np.arange(width)
            i_in, j_in = np.minimum(i, len(group) - 1), np.minimum(j, len(group) - 1)
            ok_i, ok_j = (x < len(group) for x in (i, j))
            ok_i &= group[i_in] == group[f][:, None]
            ok_j &= group[j_in] == group[f][:, None]
            a, b = size[i_in][:, :, None], size[j_in][:, None, :]
            low, high = np.minimum(a, b), np.maximum(a, b)
            least = short[f][:, None, None]
            wide = int(max(size[i_in].max(), size[j_in].max()))
            ahead = np.minimum(common(left[i_in, :wide], left[j_in, :wide]), low)
            behind = np.minimum(common(right[i_in, :wide], right[j_in, :wide]), low)
            hit = (ahead + behind >= high - 1) & (low == least) & (i[:, :, None] < j[:, None, :])
            hit &= ok_i[:, :, None] & ok_j[:, None, :] & (ahead >= since[f][:, None, None])
            end = until[f][:, None, None]
            hit &= (ahead < end) | ((end == least) & (ahead == end))
            at, x, y = np.nonzero(hit)
            found.append((i[at, x], j[at, y]))
    return np.concatenate([p for p, _ in found]), np.concatenate([p for _, p in found])


def _partners(rows: pa.Table) -> pa.RecordBatch:
    """Each word's number of near words in the groups at hand, and the best of them."""
    words, n = rows.column("word").to_pylist(), rows.column("n").to_numpy()
    keys = [rows.column(c).to_numpy() for c in ("short", "since", "until", "key")]
    group = np.cumsum(np.any([np.r_[True, k[1:] != k[:-1]] for k in keys], axis=0))
    i, j = near_pairs(*matrices(words), group, *keys[:3])
    i, j = np.concatenate([i, j]), np.concatenate([j, i])
    # best partner first: most frequent, then smallest
    place = np.empty(len(words), np.int64)
    place[sorted(range(len(words)), key=lambda k: (-n[k], words[k]))] = np.arange(len(words))
    order = np.lexsort((place[j], i))
    i, j = i[order], j[order]
    top = np.flatnonzero(np.r_[True, i[1:] != i[:-1]]) if len(i) else np.zeros(0, np.int64)
    many = np.diff(np.r_[top, len(i)])
    return pa.RecordBatch.from_arrays(
        [pa.array([words[k] for k in i[top]], pa.string()), pa.array(many, pa.int64()),
         pa.array(-n[j[top]], pa.int64()), pa.array([words[k] for k in j[top]], pa.string())],
        ["word", "n_near", "rank", "form"],
    )


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole groups at a time, of rows that come in order of their groups."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(batch.schema.get_field_index(c)).to_numpy()
                for c in ("short", "since", "until", "key")]
        turn = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
        first = tuple(k[0] for k in keys)
        if held:
            last = held[-1].slice(held[-1].num_rows - 1)
            if first != tuple(last.column(last.schema.get_field_index(c))[0].as_py()
                              for c in ("short", "since", "until", "key")):
                yield _partners(pa.Table.from_batches(held))
                held = []
        if len(turn):
            whole = int(turn[-1])
            yield _partners(pa.Table.from_batches([*held, batch.slice(0, whole)]))
            held = [batch.slice(whole)]
        else:
            held.append(batch)
    if held:
        yield _partners(pa.Table.from_batches(held))


def near_words(words: DataFrame, *, crowd: int = CROWD) -> DataFrame:
    """``word``, ``n_near``, and the near word of largest n as ``near`` with ``near_n``.

    Of equally frequent near words the smallest in code-point order counts. Words without a
    near one are not returned.
    """
    group = ["short", "since", "until", "key"]
    tiled = (
        groups_of(words, crowd=crowd).repartition(*group).sortWithinPartitions(*group)
        .mapInArrow(_tiles, "word string, n_near long, rank long, form string")
    )
    best = F.min(F.struct("rank", "form"))
    return tiled.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select(
        "word", "n_near", F.col("best.form").alias("near"), (-F.col("best.rank")).alias("near_n"))


def roots_of(links: DataFrame) -> DataFrame:
    """``word`` and the ``root`` at the end of its forms; every round doubles the steps taken.

    n at least doubles with each form, so chains end, after at most log2 of the largest n.
    """
    reach = stage(links.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "reach")
    while not reach.filter("moved").isEmpty():
        hop = reach.select(F.col("word").alias("root"), F.col("root").alias("further"))
        reach = stage(reach.join(hop, "root", "left").select(
            "word", F.coalesce("further", "root").alias("root"),
            F.col("further").isNotNull().alias("moved")), "reach")
    return reach.select("word", "root")


def group_variants(docs: DataFrame, *, least_length: int = LEAST_LENGTH,
                   least_count: int = LEAST_COUNT, ratio: int = 2, crowd: int = CROWD) -> DataFrame:
    """``word``, ``form``, ``root``, ``n``, ``n_near`` and ``form_n`` of every word of ``docs``.

    A word's form is its most frequent near word, if that is ``ratio`` times as frequent or
    more; the root follows forms to the last. Null and empty texts have no words; rows that
    repeat count again; columns other than doc_id and text are ignored; no rows or no words
    give no rows. Runs may be of any length.
    """
    words = stage(vocabulary(docs, least_length=least_length, least_count=least_count), "words")
    fit = F.col("near_n") >= ratio * F.col("n")
    rows = stage(words.join(near_words(words, crowd=crowd), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(fit, F.col("near")).alias("form"), F.when(fit, F.col("near_n")).alias("form_n"),
    ), "near")
    ends = roots_of(rows.filter("form IS NOT NULL"))
    return rows.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def oracle() -> str:
    """DuckDB SQL for :func:`group_variants`: near pairs by equality of one-point deletions."""
    return f"""
WITH RECURSIVE crc(i, k, c) AS (
  SELECT range, 0, range::BIGINT FROM range(256)
  UNION ALL
  SELECT i, k + 1, xor(c >> 1, 3988292384 * (c & 1)) FROM crc WHERE k < 8
),
steps AS (SELECT list(c ORDER BY i) AS t FROM crc WHERE k = 8),
runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS doc, run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
                                                 '[a-zÀ-ÿ]+')) AS run FROM documents)
  GROUP BY ALL
),
hashed AS (
  SELECT run, n, xor(list_reduce(
      list_transform(range(1, octet_length(encode(doc || ':' || run)) + 1),
                     lambda k: ('0x' || substr(hex(encode(doc || ':' || run)), 2 * k - 1, 2))::BIGINT),
      lambda a, b: xor(a >> 8, t[xor(a & 255, b) + 1]), 4294967295), 4294967295) AS h
  FROM runs, steps
),
words AS (
  SELECT word, sum(n)::BIGINT AS n FROM (
    SELECT CASE WHEN h % 97 = 0
      THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2)
      ELSE run END AS word, n
    FROM hashed)
  WHERE length(word) >= {LEAST_LENGTH} GROUP BY word HAVING sum(n) >= {LEAST_COUNT}
),
dels AS (
  SELECT word, n, i, substr(word, 1, i::INT) || substr(word, i::INT + 2) AS rest
  FROM words, unnest(range(length(word))) AS u(i)
),
near AS (
  SELECT a.word, b.word AS other, b.n FROM dels a JOIN dels b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM dels a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM dels a JOIN words b ON a.rest = b.word
),
best AS (
  SELECT word, count(*) AS n_near, first(other ORDER BY n DESC, encode(other)) AS near, max(n) AS near_n
  FROM near GROUP BY word
),
forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near,
    CASE WHEN near_n >= 2 * w.n THEN near END AS form,
    CASE WHEN near_n >= 2 * w.n THEN near_n END AS form_n
  FROM words w LEFT JOIN best USING (word)
),
ends(word, root) AS (
  SELECT word, word FROM forms WHERE form IS NULL
  UNION ALL SELECT f.word, e.root FROM forms f JOIN ends e ON f.form = e.word
)
SELECT word, form, root, n, n_near::BIGINT AS n_near, form_n
FROM forms JOIN ends USING (word)
"""
