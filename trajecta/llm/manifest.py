"""Merkle manifest of a dataset, kept as a postorder append log.

Leaves of a tree are numbered in order; every ``ARITY`` consecutive nodes become one of the
next level, until one is left. Appending leaves one by one and writing each node as soon as
it is complete gives the log of a tree: nodes in postorder. A node of level l whose last leaf
is e stands at

    position(e, l) = (3 e - digits(e)) / 2 + l        (digits: the sum of e's base-3 digits)

because 3^i leaves complete one node of level i, and the levels below l that end at e come
just before it. A full subtree is contiguous, so a builder that takes ``3**k`` aligned leaves
writes one segment of the log, and inside the segment the same formula holds. Builders of
the next round take the tops of segments as leaves. Siblings are then read by their place in a
segment; what lies above a segment is the same for all of its leaves and is handed down once.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, read_table
from .ordering import with_index

ARITY = 3
LEVELS = 7  # levels that a builder completes: it takes 2,187 leaves
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("ascii")).hexdigest()


def position(last: np.ndarray | int, level: int = 0):
    """Place in the log (from 0) of the node of ``level`` whose last leaf is ``last``."""
    e, digits = np.asarray(last, dtype=np.int64), 0
    rest = e
    while np.any(rest):
        digits, rest = digits + rest % ARITY, rest // ARITY
    return (ARITY * e - digits) // (ARITY - 1) + level


def heights(leaves: int, above: bool, levels: int = LEVELS) -> list[int]:
    """Nodes on each level of a segment of so many leaves; one that has levels above it goes up to its full height."""
    out = [leaves]
    while len(out) <= levels and (out[-1] > 1 or above):
        out.append(-(-out[-1] // ARITY))
    return out


def append_log(leaves: list[str], above: bool, levels: int = LEVELS) -> list[str]:
    """Nodes of one segment in completion order."""
    sizes, log, open_ = heights(len(leaves), above, levels), [], [[] for _ in range(levels + 1)]
    for i, leaf in enumerate(leaves):
        node, level = leaf, 0
        while True:
            log.append(node)
            open_[level].append(node)
            ends = i == len(leaves) - 1
            if level + 1 == len(sizes) or not (len(open_[level]) == ARITY or ends):
                break
            node = _sha("".join(open_[level]))
            open_[level].clear()
            level += 1
    return log


def log_levels(log: list[str], leaves: int, above: bool, levels: int = LEVELS) -> list[list[str]]:
    """The nodes of each level of a segment, read from their places in its log."""
    out = []
    for level, size in enumerate(heights(leaves, above, levels)):
        last = np.minimum((np.arange(size) + 1) * ARITY**level, leaves) - 1
        out.append([log[p] for p in position(last, level)])
    return out


def _hex(raw: bytes) -> list[str]:
    text = raw.hex()
    return [text[i : i + 64] for i in range(0, len(text), 64)]


def sibling_paths(nodes: list[list[str]], rest: list[tuple[str, str]]) -> list[list[tuple[str, str]]]:
    """For each leaf of a segment with these nodes by level: what stands left and right of its node on each level, up to the root."""
    paths = [rest]
    for level in reversed(nodes[:-1]):
        below = []
        for j in range(len(level)):
            run = j - j % ARITY
            below.append([("".join(level[run:j]), "".join(level[j + 1 : run + ARITY])), *paths[j // ARITY]])
        paths = below
    return paths


def fold(leaf: str, path: list[tuple[str, str]]) -> str:
    """The root that a leaf and its siblings give."""
    for left, right in path:
        leaf = _sha(left + leaf + right)
    return leaf


@dataclass
class Manifest:
    """Trees of one builder: a table of segments for each round, and ``tops(tree, round, root)``."""

    rounds: list[DataFrame]
    tops: DataFrame
    levels: int


_SEGMENT_SCHEMA = "tree string, block long, n long, first long, log binary, top binary, ids array<long>, others binary"


def _segment(table: pa.Table, levels: int) -> pa.Table:
    """One aligned builder: the rows of a block in, its segment out."""
    table = table.sort_by("idx")
    n, block, full = table["n"][0].as_py(), table["block"][0].as_py(), ARITY**levels
    log = append_log([x.hex() for x in table["leaf"].to_pylist()], n > full, levels)
    raw = bytes.fromhex("".join(log))
    return pa.Table.from_pylist([{
        "tree": table["tree"][0].as_py(), "block": block, "n": n, "first": int(position(block * full)),
        "log": raw, "top": raw[-32:], "ids": table["id"].to_pylist(), "others": b"".join(table["other"].to_pylist()),
    }], schema=pa.schema([("tree", pa.string()), ("block", pa.int64()), ("n", pa.int64()), ("first", pa.int64()), ("log", pa.binary()), ("top", pa.binary()), ("ids", pa.list_(pa.int64())), ("others", pa.binary())]))


def build(rows: DataFrame, name: str, levels: int = LEVELS) -> Manifest:
    """Trees over ``rows(tree, idx, n, leaf, id, other)``: digests as 32 bytes, ``idx`` dense from 0 in each tree.

    ``id`` and ``other`` (a second digest) are kept with the first round's segments. A round's
    builders are as many as its leaves over ``ARITY ** levels``; a next one runs only for trees with
    more than one segment, so there are as many rounds as the largest tree needs.
    """
    rounds, tops, full = [], [], ARITY**levels
    while True:
        rows = rows.select("tree", "idx", "n", "leaf", "id", "other", F.floor(F.col("idx") / full).alias("block"))
        done = materialize(rows.groupBy("tree", "block").applyInArrow(lambda t: _segment(t, levels), _SEGMENT_SCHEMA), name)
        rounds.append(done)
        tops.append(done.where(F.col("n") <= full).select("tree", F.lit(len(rounds) - 1).alias("round"), F.col("top").alias("root")))
        rest = done.where(F.col("n") > full)
        if rest.isEmpty():
            break
        rows = rest.select("tree", F.col("block").alias("idx"), F.ceil(F.col("n") / full).alias("n"), F.col("top").alias("leaf"), F.lit(None).cast("long").alias("id"), F.unhex(F.lit("")).alias("other"))
    out = tops[0]
    for t in tops[1:]:
        out = out.unionByName(t)
    return Manifest(rounds, out, levels)


_PATH = "array<struct<left:string,right:string>>"
_PATH_ARROW = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))


def _leaf_paths(segments: pa.Table, levels: int):
    """(segment, number of its first leaf, its leaves' digests, their paths) of each row."""
    full = ARITY**levels
    for r in segments.to_pylist():
        n, above = min(full, r["n"] - r["block"] * full), r["n"] > full
        nodes = log_levels(_hex(r["log"]), n, above, levels)
        yield r, r["block"] * full, nodes[0], sibling_paths(nodes, [(p["left"], p["right"]) for p in r["path"]])


def _path_rows(path: list[tuple[str, str]]) -> list[dict]:
    return [{"left": a, "right": b} for a, b in path]


def hand_down(trees: Manifest, outer: DataFrame, name: str) -> DataFrame:
    """The first round's segments with ``path``, the siblings above each segment, and ``subroot, root``.

    ``outer(tree, round, path, subroot, root)`` has what lies above each tree, and the round in
    which it is complete. Rounds go from the top down; a path is one row for a whole segment.
    """
    kind = pa.schema([("tree", pa.string()), ("block", pa.int64()), ("path", _PATH_ARROW), ("subroot", pa.string()), ("root", pa.string())])

    levels = trees.levels

    def below(segments: pa.Table) -> pa.Table:
        out = []
        for r, start, _, paths in _leaf_paths(segments, levels):
            out += [{"tree": r["tree"], "block": start + i, "path": _path_rows(p), "subroot": r["subroot"], "root": r["root"]} for i, p in enumerate(paths)]
        return pa.Table.from_pylist(out, schema=kind)

    paths = None
    for i in range(len(trees.rounds) - 1, -1, -1):
        own = outer.where(F.col("round") == i).select("tree", F.lit(0).cast("long").alias("block"), "path", "subroot", "root")
        known = materialize(own if paths is None else own.unionByName(paths), f"{name}-paths")  # its size is then known to the join
        found = trees.rounds[i].join(known, ["tree", "block"])
        paths = found.groupBy("tree", "block").applyInArrow(below, f"tree string, block long, path {_PATH}, subroot string, root string")
    return found


def _encoded(c: Column) -> Column:
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(fields: list[Column]) -> Column:
    """sha256 (32 bytes) of the fields in order: ``-`` for null, else the UTF-8 byte count, a colon and the value."""
    return F.unhex(F.sha2(F.concat(*[_encoded(f) for f in fields]), 256))


def verified_manifest(docs: DataFrame, others: Column, fields: list[str] = FIELDS, tree: str = "source", order: str = "doc_id", levels: int = LEVELS) -> DataFrame:
    """The manifest of ``docs``, and whether each row's copy with the text ``others`` still fits it.

    One tree for each value of ``tree``, over rows ascending by ``order``; the trees' roots, by
    that value (null first, bytewise), are the leaves of the tree that gives the root. Returns,
    for each row: ``doc_id, leaf, subroot, root, proof_sha256`` (of the siblings' digests in
    order, from leaf to root), ``folded_root`` (from the other text's leaf and the siblings)
    and ``verified``; digests in lowercase hex.

    Null fields count as ``-`` (null ids come first). Rows that repeat an id are leaves of their
    own, by digest; a repeated row is as many equal leaves. Texts may be empty or of any length:
    only digests are shuffled. Further columns are ignored; an empty table gives no rows.
    """
    row = docs.select(*fields, others.alias("_other"))
    leaf = leaf_digest([F.col(f) for f in fields])
    other = leaf_digest([F.col("_other" if f == "text" else f) for f in fields])
    key = F.coalesce(F.concat(F.lit("="), F.col(tree).cast("string")), F.lit(""))  # null first, then bytewise
    leaves = row.select(key.alias("tree"), F.col(order).alias("id"), leaf.alias("leaf"), other.alias("other"))
    placed, used = with_index(leaves, "tree", ["id", "leaf", "other"], "leaves")
    trees = build(placed, "segments", levels)
    discard(*used)
    tops = trees.tops.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "round", F.col("root").alias("leaf"))
    placed = materialize(with_index(tops, "tree", ["name"], "names")[0], "subroots")
    none = placed.withColumn("id", F.col("idx")).withColumn("other", F.unhex(F.lit("")))
    upper = build(none, "upper", levels)
    top = upper.tops.select("tree", "round", F.array().cast(_PATH).alias("path"), F.lit("").alias("subroot"), F.lower(F.hex("root")).alias("root"))
    above = hand_down(upper, top, "upper")
    by_tree = above.groupBy("tree", "block").applyInArrow(lambda t: _tree_paths(t, levels), f"idx long, path {_PATH}, root string")
    outer = materialize(placed.select("idx", F.col("name").alias("tree"), "round", F.lower(F.hex("leaf")).alias("subroot")).join(by_tree.hint("merge"), "idx"), "outer")
    found = hand_down(trees, outer, "trees")
    return found.groupBy("tree", "block").applyInArrow(lambda t: _checked(t, levels), "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def _tree_paths(segments: pa.Table, levels: int) -> pa.Table:
    """What lies above each leaf of the tree of trees."""
    out = [{"idx": start + i, "path": _path_rows(p), "root": r["root"]} for r, start, _, paths in _leaf_paths(segments, levels) for i, p in enumerate(paths)]
    return pa.Table.from_pylist(out, schema=pa.schema([("idx", pa.int64()), ("path", _PATH_ARROW), ("root", pa.string())]))


def _checked(segments: pa.Table, levels: int) -> pa.Table:
    """The rows of a segment with their proofs, and the root that each one's other digest gives."""
    kind, out = pa.schema([("doc_id", pa.int64()), *[(c, pa.string()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")], ("verified", pa.bool_())]), []
    for r, _, leaves, paths in _leaf_paths(segments, levels):
        for i, (own, other, path) in enumerate(zip(leaves, _hex(r["others"]), paths, strict=True)):
            back = fold(other, path)
            out.append((r["ids"][i], own, r["subroot"], r["root"], _sha("".join(a + b for a, b in path)), back, back == r["root"]))
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kind.types, strict=True)], schema=kind)


def without_line_ends(docs: DataFrame) -> Column:
    """The text, or where 2 divides the crc32 of the doc_id the text without line ends."""
    even = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    return F.when(even, F.translate("text", "\n", "")).otherwise(F.col("text"))


def op12_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    """Contract query: a tree for each source of ``documents``, half of the rows read back without line ends."""
    docs = read_table(spark, sf_dir, "documents")
    return verified_manifest(docs, without_line_ends(docs))


def _sql_leaf(text: str) -> str:
    fields = ["doc_id", "source", "lang", "n_chars", text]
    return "sha256(" + " || ".join(f"coalesce(octet_length(encode(CAST({f} AS VARCHAR))) || ':' || CAST({f} AS VARCHAR), '-')" for f in fields) + ")"


#: The last bit of a crc32, bit by bit: it starts from and ends with all bits turned, so an even one has a 1 left.
_SQL_EVEN = """list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, length(id) + 1), lambda i: ascii(id[i])::BIGINT)),
    lambda c, b: list_reduce(list_concat([xor(c, b)], list_transform(range(8), lambda j: 0::BIGINT)), lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))) % 2 = 1"""


def _sql_tree(name: str, leaves: str) -> str:
    return f"""{name}(tree, level, idx, n, h) AS (SELECT tree, 0, idx, n, h FROM {leaves}
UNION ALL SELECT tree, level + 1, idx // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY idx)) FROM {name} WHERE n > 1 GROUP BY tree, level, idx // 3, n),
{name}_runs AS (SELECT tree, level, idx // 3 AS run, list(h ORDER BY idx) AS hs FROM {name} WHERE n > 1 GROUP BY ALL)"""


def _sql_walk(name: str, tree: str, start: str) -> str:
    left, right = "array_to_string(r.hs[: w.idx % 3], '')", "array_to_string(r.hs[w.idx % 3 + 2 :], '')"
    return f"""{name}(row, tree, level, idx, n, h, proof) AS ({start}
UNION ALL SELECT w.row, w.tree, w.level + 1, w.idx // 3, (w.n + 2) // 3, sha256({left} || w.h || {right}), w.proof || {left} || {right}
FROM {name} w JOIN {tree}_runs r ON r.tree = w.tree AND r.level = w.level AND r.run = w.idx // 3 WHERE w.n > 1)"""


ORACLE_SQL = f"""WITH RECURSIVE d AS (SELECT *, coalesce('=' || source, '') AS tree, CAST(doc_id AS VARCHAR) AS id FROM documents),
t AS (SELECT *, coalesce({_SQL_EVEN}, false) AS even FROM d),
s AS (SELECT doc_id, tree, {_sql_leaf('text')} AS h, CASE WHEN even THEN {_sql_leaf("replace(text, chr(10), '')")} ELSE {_sql_leaf('text')} END AS other FROM t),
l AS (SELECT *, row_number() OVER () AS row, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, h, other) - 1 AS idx, count(*) OVER (PARTITION BY tree) AS n FROM s),
{_sql_tree('inner_tree', 'l')},
roots AS (SELECT '' AS tree, tree AS name, h, row_number() OVER (ORDER BY tree) - 1 AS idx, count(*) OVER () AS n FROM inner_tree WHERE n = 1),
{_sql_tree('outer_tree', 'roots')},
{_sql_walk('inner_walk', 'inner_tree', "SELECT row, tree, 0, idx, n, other, '' FROM l")},
{_sql_walk('outer_walk', 'outer_tree', "SELECT i.row, '', 0, r.idx, r.n, i.h, i.proof FROM inner_walk i JOIN roots r ON r.name = i.tree WHERE i.n = 1")}
SELECT l.doc_id, l.h AS leaf, r.h AS subroot, o.h AS root, sha256(w.proof) AS proof_sha256, w.h AS folded_root, w.h = o.h AS verified
FROM l JOIN roots r ON r.name = l.tree JOIN outer_walk w ON w.row = l.row AND w.n = 1 JOIN outer_tree o ON o.n = 1"""
