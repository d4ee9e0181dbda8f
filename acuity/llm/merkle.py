"""A Merkle manifest of a dataset: one leaf per row, a tree per language, and a tree of those.

Leaves of a language stand in order of doc_id. Their places are found without sorting the
rows, by bitmap rank: the doc_ids of each language become a bitmap of 64-bit words, of which
only words that are not empty are kept, merged by bitwise or before and after one shuffle. A directory
of popcounts (a radix tree over word numbers, ``FAN`` children a node) gives the count of rows
ahead of each word; the popcount of the lower bits of its word gives a row's place.

The places key slot arrays: ``FAN`` consecutive leaves meet in one group, which reduces four
levels at once; its results are the next, ``FAN`` times smaller table. On the way down the same
groups hand each node its siblings. A group never holds more than ``FAN`` nodes, whatever the
size of a language.

A node is the lowercase hex SHA-256 of what it stands for, joined as text.
"""

from __future__ import annotations

import hashlib
from binascii import hexlify, unhexlify
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from acuity.llm.common import column, stage, whole_groups
from acuity.operators.skew import running_total

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Children of a node, levels reduced in one group, and the nodes such a group holds.
ARITY, DEEP = 8, 4
FAN = ARITY**DEEP
#: Width in bits of one step in the popcount directory.
STEP = 12
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TREE = ["tree", "block"]


def leaf_of(values: Sequence[Column]) -> Column:
    """Hex digest of the fields: ``-`` for null, else UTF-8 byte count, ``:`` and the value."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[
        F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t))
        for t in texts
    ]).cast("binary"), 256)


def leaves_of(docs: DataFrame, *, every: int = 3) -> DataFrame:
    """``tree``, ``doc_id``, ``leaf`` and ``changed``, the leaf after tampering where that takes place.

    ``tree`` is the language behind ``=``, and empty for the null one, so that it sorts first.
    Rows whose decimal doc_id has a crc32 that ``every`` divides are tampered with: A-Z of
    their text become lower case. A null doc_id is never tampered with.
    """
    values = {c: column(docs, c) for c in FIELDS}
    lowered = values | {"text": F.translate(values["text"].cast("string"), UPPER, LOWER)}
    hit = F.crc32(values["doc_id"].cast("string")) % every == 0
    return docs.select(
        F.coalesce(F.concat(F.lit("="), values["lang"].cast("string")), F.lit("")).alias("tree"),
        values["doc_id"].cast("long").alias("doc_id"),
        F.unhex(leaf_of(list(values.values()))).alias("leaf"),
        F.when(hit, F.unhex(leaf_of(list(lowered.values())))).alias("changed"),
    )


def _word(doc_id: str) -> Column:
    """Number of the 64-bit word of a doc_id; null comes ahead of all."""
    return F.coalesce(F.shiftright(doc_id, 6), F.lit(-(1 << 58)))


def _at(doc_id: str) -> Column:
    return F.col(doc_id).bitwiseAND(F.lit(63).cast("long")).cast("int")


def _bit(doc_id: str) -> Column:
    one = F.call_function("shiftleft", F.lit(1).cast("long"), _at(doc_id))
    return F.coalesce(one, F.lit(0).cast("long"))


def bitmaps(leaves: DataFrame) -> DataFrame:
    """``tree``, ``word``, its ``bits``, and the number of ``rows``, more than bits where ids repeat."""
    return leaves.groupBy("tree", _word("doc_id").alias("word")).agg(
        F.bit_or(_bit("doc_id")).alias("bits"), F.count(F.lit(1)).alias("rows"))


def directory(words: DataFrame) -> DataFrame:
    """``words`` with the rows of its tree ahead of each word (``base``), and in all (``n``).

    Counts go up a radix tree over word numbers until every tree has one node's worth left,
    then offsets come down again. A window spans the children of one node, 2^STEP at most.
    """
    levels = [words.select("tree", "word", "rows")]
    while not levels[-1].groupBy("tree").count().filter(F.col("count") > 1 << STEP).isEmpty():
        levels.append(stage(
            levels[-1].groupBy("tree", F.shiftright("word", STEP).alias("word")).agg(F.sum("rows").alias("rows")),
            "directory"))

    def ahead(*node: Column | str) -> Column:
        earlier = Window.partitionBy("tree", *node).orderBy("word").rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum("rows").over(earlier), F.lit(0)).cast("long")

    base = levels[-1].select(
        "tree", "word", ahead().alias("base"), F.sum("rows").over(Window.partitionBy("tree")).alias("n"))
    for level in reversed(levels[:-1]):
        parent = F.shiftright("word", STEP)
        offsets = level.select("tree", "word", parent.alias("up"), ahead(parent).alias("ahead"))
        above = base.select("tree", F.col("word").alias("up"), "base", "n")
        base = stage(offsets.join(above, ["tree", "up"]).select(
            "tree", "word", (F.col("base") + F.col("ahead")).alias("base"), "n"), "offsets")
    return words.join(base, ["tree", "word"])


def placed(leaves: DataFrame) -> DataFrame:
    """``leaves`` with their 0-based ``place`` in the tree and its number of leaves ``n``.

    Rows that repeat a doc_id within a language follow each other in order of their leaf;
    equal ones are interchangeable. Rows without a doc_id come first.
    """
    words = stage(directory(stage(bitmaps(leaves), "bitmaps")), "ranks")
    rows = leaves.withColumn("word", _word("doc_id")).join(words, ["tree", "word"])
    single = F.col("rows") <= F.greatest(F.bit_count("bits"), F.lit(1))
    # the bits up to the row's own, moved to the top, without itself
    up_to = F.call_function("shiftleft", "bits", (63 - _at("doc_id")).cast("int"))
    inside = F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(F.bit_count(up_to) - 1)
    keep = ["tree", "n", "doc_id", "leaf", "changed"]
    out = rows.filter(single).select(*keep, (F.col("base") + inside).alias("place"))
    if words.filter(~single).isEmpty():
        return out
    again = running_total(
        rows.filter(~single).select(*keep, "word", "base"), ["tree", "word"],
        [F.col("doc_id").asc_nulls_first(), F.col("leaf")])
    return out.unionByName(again.select(*keep, (F.col("base") + F.col("before")).alias("place")))


def levels_left(n: int) -> int:
    """Levels that reduce ``n`` nodes to one."""
    levels = 0
    while n > 1:
        n, levels = -(-n // ARITY), levels + 1
    return levels


def _reduce(nodes: bytes, levels: int) -> list[bytes]:
    """The hex nodes of a group, joined, at every level from the given one up."""
    out, size = [nodes], 64 * ARITY
    for _ in range(levels):
        below = out[-1]
        out.append(b"".join(
            hashlib.sha256(below[i : i + size]).hexdigest().encode() for i in range(0, len(below), size)))
    return out


def _steps(levels: list[bytes], at: int) -> list[bytes]:
    """Left and right siblings, level by level, of the node at ``at`` in the lowest level."""
    out = []
    for nodes in levels[:-1]:
        run = at // ARITY * ARITY
        out.append(nodes[64 * run : 64 * at])
        out.append(nodes[64 * (at + 1) : 64 * (run + ARITY)])
        at //= ARITY
    return out


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, int, int]]:
    """Tables with the bounds of each (tree, block) group in them."""
    for table in whole_groups(batches, TREE):
        tree, block = table.column("tree").to_pylist(), table.column("block").to_pylist()
        turn = [i for i in range(1, len(tree)) if tree[i] != tree[i - 1] or block[i] != block[i - 1]]
        for a, b in zip([0, *turn], [*turn, len(tree)]):
            yield table, a, b


def _up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table, a, b in _groups(batches):
        n = table.column("n")[a].as_py()
        levels = min(DEEP, levels_left(n))
        nodes = hexlify(b"".join(table.column("node").slice(a, b - a).to_pylist()))
        top = unhexlify(_reduce(nodes, levels)[-1])
        for _ in range(levels):
            n = -(-n // ARITY)
        yield pa.RecordBatch.from_arrays(
            [table.column("tree").slice(a, 1).combine_chunks(), table.column("block").slice(a, 1).combine_chunks(),
             pa.array([n], pa.int64()), pa.array([top], pa.binary())], ["tree", "place", "n", "node"])


def _dealt(nodes: DataFrame, *order: str) -> DataFrame:
    return nodes.repartition(*TREE).sortWithinPartitions(*TREE, *order)


def _block() -> Column:
    return F.expr(f"place div {FAN}").alias("block")


def climb(nodes: DataFrame) -> list[DataFrame]:
    """Tables of ``tree``, ``place``, ``n``, ``node``, each up to ``FAN`` times smaller, to one node a tree."""
    tables = [nodes.select("tree", "place", "n", "node")]
    most = tables[0].agg(F.max("n")).first()[0] or 1
    for _ in range(-(-levels_left(most) // DEEP)):
        below = _dealt(tables[-1].select("tree", _block(), "place", "n", "node"), "place")
        tables.append(stage(below.mapInArrow(_up, "tree string, place long, n long, node binary"), "nodes"))
    return tables


def _down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The siblings of each node up to the root; a group's first row has those of the group."""
    for table, a, b in _groups(batches):
        rows = table.slice(a, b - a).select(["tree", "place", "n", "node", "path", "subroot", "root"]).to_pylist()
        head, rows = rows[0], rows[1:]
        if not rows:
            continue
        levels = _reduce(hexlify(b"".join(r["node"] for r in rows)), min(DEEP, levels_left(rows[0]["n"])))
        paths = [[*_steps(levels, i), *head["path"]] for i in range(len(rows))]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r["tree"] for r in rows], pa.string()), pa.array([r["place"] for r in rows], pa.int64()),
             pa.array(paths, pa.list_(pa.binary())),
             pa.array([head["subroot"]] * len(rows), pa.binary()), pa.array([head["root"]] * len(rows), pa.binary())],
            ["tree", "place", "path", "subroot", "root"])


def _prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each leaf the digest of its siblings, and the root its present content folds to."""
    for table, a, b in _groups(batches):
        part = table.slice(a, b - a)
        path, subroot, root = (part.column(c)[0].as_py() for c in ("path", "subroot", "root"))
        part = part.slice(1)
        if not part.num_rows:
            continue
        leaves, changed = part.column("node").to_pylist(), part.column("changed").to_pylist()
        nodes = hexlify(b"".join(leaves))
        levels = _reduce(nodes, min(DEEP, levels_left(part.column("n")[0].as_py())))
        root_hex = hexlify(root).decode()
        proofs, folded = [], []
        for i, (leaf, other) in enumerate(zip(leaves, changed)):
            steps = [*_steps(levels, i), *path]
            proofs.append(hashlib.sha256(b"".join(steps)).hexdigest())
            node = hexlify(leaf if other is None else other)
            for left, right in zip(steps[::2], steps[1::2]):
                node = hashlib.sha256(left + node + right).hexdigest().encode()
            folded.append(node.decode())
        yield pa.RecordBatch.from_arrays(
            [part.column("doc_id").combine_chunks(),
             pa.array([nodes[64 * i : 64 * i + 64].decode() for i in range(len(leaves))], pa.string()),
             pa.array([hexlify(subroot).decode()] * len(leaves), pa.string()),
             pa.array([root_hex] * len(leaves), pa.string()), pa.array(proofs, pa.string()),
             pa.array(folded, pa.string()), pa.array([f == root_hex for f in folded], pa.bool_())],
            ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])


PATH = "path array<binary>, subroot binary, root binary"


def _with_paths(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """Nodes in groups, ahead of each group the path of the node it reduces to."""
    heads = paths.select("tree", F.col("place").alias("block"), F.lit(-1).cast("long").alias("place"),
                         "path", "subroot", "root")
    rows = nodes.select("*", _block()).unionByName(heads, allowMissingColumns=True)
    return _dealt(rows, "place")


def descend(tables: Sequence[DataFrame], paths: DataFrame) -> DataFrame:
    """Paths of the nodes of the second of ``tables`` (of the only one), from those of the trees' roots."""
    for nodes in list(reversed(tables))[1:-1]:
        paths = stage(_with_paths(nodes, paths).mapInArrow(_down, f"tree string, place long, {PATH}"), "paths")
    return paths


@dataclass
class Manifest:
    """``leaves`` with their places, the node tables of the language trees, and of the tree of those."""

    leaves: DataFrame
    languages: list[DataFrame]
    whole: list[DataFrame]

    def root(self) -> str | None:
        """The root digest; None without rows."""
        found = self.whole[-1].select(F.lower(F.hex("node"))).first()
        return found and found[0]


def build(docs: DataFrame) -> Manifest:
    """The manifest of ``docs``. Columns other than ``FIELDS`` are ignored."""
    leaves = stage(placed(stage(leaves_of(docs), "leaves")), "placed")
    languages = climb(leaves.select("tree", "place", "n", F.col("leaf").alias("node")))
    subroots = languages[-1].select(F.col("tree").alias("language"), "node")
    order = running_total(subroots, [], [F.col("language")], before="place", total="n")
    ordered = stage(order.select(F.lit("").alias("tree"), "place", "n", "node", "language"), "subroots")
    whole = climb(ordered)
    return Manifest(leaves, languages, [ordered, *whole[1:]])


def prove(manifest: Manifest) -> DataFrame:
    """One row per leaf: ``doc_id``, ``leaf``, ``subroot``, ``root``, ``proof_sha256``,
    ``folded_root`` and ``verified``, whether that equals the root.

    Siblings are those of the original leaves; ``folded_root`` starts from the tampered leaf
    where there is one. A lone leaf is its language's subroot, and a lone subroot the root.
    """
    root = manifest.whole[-1].select("tree", "place", F.col("node").alias("root"))
    empty = F.array().cast("array<binary>")
    tops = descend([*manifest.whole], root.select(
        "tree", "place", empty.alias("path"), F.lit(None).cast("binary").alias("subroot"), "root"))
    subroots = manifest.whole[0]
    if len(manifest.whole) > 1:
        tops = stage(_with_paths(subroots.drop("language"), tops)
                     .mapInArrow(_down, f"tree string, place long, {PATH}"), "tops")
    paths = subroots.select("place", "language", F.col("node").alias("own")).join(
        tops.select("place", "path", "root"), "place").select(
        F.col("language").alias("tree"), F.lit(0).cast("long").alias("place"), "path",
        F.col("own").alias("subroot"), "root")
    paths = descend(manifest.languages, paths)
    leaves = manifest.leaves.withColumnRenamed("leaf", "node")
    return _with_paths(leaves, paths).mapInArrow(
        _prove, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, "
                "folded_root string, verified boolean")


def proofs(docs: DataFrame) -> DataFrame:
    """Manifest and proofs of ``docs`` in one go.

    Any column may be null. Empty and very long texts are leaves like others; rows that repeat
    are leaves of their own; without rows there is no root and no row.
    """
    return prove(build(docs))


def oracle() -> str:
    """DuckDB SQL for :func:`proofs`, with the levels as recursion."""
    def field(name: str) -> str:
        return f"CASE WHEN {name} IS NULL THEN '-' ELSE octet_length(encode({name}))::VARCHAR || ':' || {name} END"

    def leaf(text: str) -> str:
        parts = ["doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text]
        return "sha256(" + " || ".join(field(p) for p in parts) + ")"

    def tree(name: str, first: str, key: str) -> str:
        return f"""{name}(level, {key}, p, n, h) AS (
  SELECT 0, {key}, p, n, h FROM {first}
  UNION ALL
  SELECT level + 1, {key}, p // {ARITY}, (n + {ARITY - 1}) // {ARITY}, sha256(string_agg(h, '' ORDER BY p))
  FROM {name} WHERE n > 1 GROUP BY level, {key}, p // {ARITY}, n
)"""

    lowered = f"translate(text, '{UPPER}', '{LOWER}')"
    bits = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    return f"""
WITH RECURSIVE crc(i, k, c) AS (
  SELECT range, 0, range::BIGINT FROM range(256)
  UNION ALL SELECT i, k + 1, {bits} FROM crc WHERE k < 8
),
steps AS (SELECT list(c ORDER BY i) AS t FROM crc WHERE k = 8),
base AS (
  SELECT doc_id, coalesce('=' || lang, '') AS tree, {leaf("text")} AS leaf, {leaf(lowered)} AS other,
    xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT),
      lambda a, b: xor(a >> 8, t[xor(a & 255, b) + 1]), 4294967295), 4294967295) % 3 = 0 AS hit
  FROM documents, steps
),
leaves AS MATERIALIZED (
  SELECT *, leaf AS h, CASE WHEN hit THEN other ELSE leaf END AS now,
    row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p,
    count(*) OVER (PARTITION BY tree) AS n
  FROM base
),
{tree("nodes", "leaves", "tree")},
subroots AS MATERIALIZED (
  SELECT tree, h, 0 AS one, row_number() OVER (ORDER BY encode(tree)) - 1 AS p, count(*) OVER () AS n
  FROM nodes WHERE n = 1
),
{tree("whole", "subroots", "one")},
root AS (SELECT h AS root FROM whole WHERE n = 1),
sides AS MATERIALIZED (
  SELECT l.tree, l.p, 0 AS part, x.level,
    coalesce(string_agg(x.h, '' ORDER BY x.p) FILTER (x.p < l.p // power({ARITY}, x.level)::BIGINT), '') AS a,
    coalesce(string_agg(x.h, '' ORDER BY x.p) FILTER (x.p > l.p // power({ARITY}, x.level)::BIGINT), '') AS b
  FROM leaves l JOIN nodes x ON x.tree = l.tree AND x.n > 1
    AND x.p // {ARITY} = l.p // power({ARITY}, x.level + 1)::BIGINT
  GROUP BY ALL
  UNION ALL
  SELECT l.tree, l.p, 1, x.level,
    coalesce(string_agg(x.h, '' ORDER BY x.p) FILTER (x.p < s.p // power({ARITY}, x.level)::BIGINT), ''),
    coalesce(string_agg(x.h, '' ORDER BY x.p) FILTER (x.p > s.p // power({ARITY}, x.level)::BIGINT), '')
  FROM leaves l JOIN subroots s ON s.tree = l.tree JOIN whole x ON x.n > 1
    AND x.p // {ARITY} = s.p // power({ARITY}, x.level + 1)::BIGINT
  GROUP BY l.tree, l.p, x.level
),
turns AS MATERIALIZED (
  SELECT tree, p, a, b, row_number() OVER (PARTITION BY tree, p ORDER BY part, level) AS k FROM sides
),
folds(tree, p, k, h) AS (
  SELECT tree, p, 0::BIGINT, now FROM leaves
  UNION ALL
  SELECT f.tree, f.p, t.k, sha256(t.a || f.h || t.b) FROM folds f JOIN turns t ON t.tree = f.tree AND t.p = f.p AND t.k = f.k + 1
),
proofs AS (
  SELECT tree, p, sha256(string_agg(a || b, '' ORDER BY k)) AS proof FROM turns GROUP BY tree, p
),
ends AS (SELECT tree, p, arg_max(h, k) AS h FROM folds GROUP BY tree, p)
SELECT l.doc_id, l.leaf, s.h AS subroot, root, coalesce(f.proof, sha256('')) AS proof_sha256,
  e.h AS folded_root, e.h = root AS verified
FROM leaves l JOIN subroots s ON s.tree = l.tree JOIN ends e ON e.tree = l.tree AND e.p = l.p
  LEFT JOIN proofs f ON f.tree = l.tree AND f.p = l.p, root
"""
