"""A Merkle manifest of a dataset: a proof for each row that it is in it, unchanged.

Each row is a leaf. The leaves of a group (a source), by id, make a tree of runs of
sixteen; the groups' roots, by group, make the tree above them. Leaves and nodes are
lowercase hex SHA-256 digests, joined as text.

Leaves are numbered inside of their group by a sort by ranges, and cut into blocks of a
power of sixteen, so that a group of any size is many blocks. Executors reduce each
block to one node. What is left is the upper tree: a node for each block, and one for
each group. The block size rises until the blocks beyond the first of each group are
TOP at most (16^5 leaves a block at most), so that with the groups, which the manifest
names one by one, it is small. The driver builds it and broadcasts the path of each of
its lowest nodes to the root; paths share their upper parts. Executors then read the
blocks again, put the siblings inside of a block before that path, and fold each row.

Only digests are shuffled, never texts: each row's leaf is made where it is read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkronym.llm.common import Scratch, numbered, ship

RUN = 16
#: Levels that executors reduce inside of a block, and blocks that the driver's tree may have besides one for each group.
LEAST_LEVELS, MOST_LEVELS, TOP = 3, 5, 4096
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def encoded(value: Column) -> Column:
    """`-` for null, else the number of bytes, a colon and the value."""
    s = value.cast("string")
    return F.when(s.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaf(values: Iterable[Column]) -> Column:
    return F.sha2(F.concat(*(encoded(v) for v in values)), 256)


def digest(parts: Iterable[bytes]) -> bytes:
    return hashlib.sha256(b"".join(parts)).hexdigest().encode()


def levels(nodes: Sequence[bytes], most: int | None = None) -> list[list[bytes]]:
    """The nodes, the digests of their runs, of those', and so on: to a single one, or exactly `most` levels above."""
    out = [list(nodes)]
    while len(out[-1]) > 1 if most is None else len(out) <= most:
        out.append([digest(out[-1][i : i + RUN]) for i in range(0, len(out[-1]), RUN)])
    return out


def siblings(tree: list[list[bytes]], i: int) -> list[tuple[bytes, bytes]]:
    """For node i of the lowest level, at each level below the last: what stands before and after it in its run."""
    out = []
    for level in tree[:-1]:
        a = i - i % RUN
        out.append((b"".join(level[a:i]), b"".join(level[i + 1 : a + RUN])))
        i //= RUN
    return out


def fold(node: bytes, steps: Iterable[tuple[bytes, bytes]]) -> bytes:
    for before, after in steps:
        node = digest((before, node, after))
    return node


def _block(table: pa.Table, deep: int) -> tuple[pa.Table, list[list[bytes]]]:
    """A block's rows by their place, and its levels."""
    table = table.sort_by("_idx")
    many = table.column("_total")[0].as_py() > RUN**deep
    return table, levels([d.hex().encode() for d in table.column("leaf").to_pylist()], deep if many else None)


def _reduce(deep: int):
    def run(table: pa.Table) -> pa.Table:
        table, tree = _block(table, deep)
        at = [table.column("_idx")[0].as_py() // RUN**deep]
        return pa.table({"group": table.column("group").slice(0, 1), "block": pa.array(at, pa.int64()), "node": pa.array([bytes.fromhex(tree[-1][0].decode())], pa.binary())})

    return run


def upper_tree(nodes: Iterable[tuple[str | None, int, bytes]]) -> tuple[bytes, dict]:
    """The root, and for each (group, block) its group's root and the steps from it to the root."""
    groups: dict = {}
    for group, block, node in sorted(nodes, key=lambda n: (n[0] is not None, (n[0] or "").encode(), n[1])):
        groups.setdefault(group, []).append(node.hex().encode())
    trees = {g: levels(own) for g, own in groups.items()}
    top = levels([t[-1][0] for t in trees.values()])
    paths = {}
    for k, (g, tree) in enumerate(trees.items()):
        above = tuple(siblings(top, k))
        shared: dict = {}  # one object for all paths that go through it
        for block in range(len(tree[0])):
            i, steps = block, []
            for depth, step in enumerate(siblings(tree, block)):
                steps.append(shared.setdefault((depth, i), step))
                i //= RUN
            paths[g, block] = tree[-1][0], (*steps, *above)
    return top[-1][0], paths


OUT = "doc_id {id}, source {group}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def _finish(deep: int, root: bytes, paths):
    def run(table: pa.Table) -> pa.Table:
        table, tree = _block(table, deep)
        group, block = table.column("group")[0].as_py(), table.column("_idx")[0].as_py() // RUN**deep
        subroot, above = paths.value[group, block]
        own, proof, folded = tree[0], [], []
        for i, other in enumerate(table.column("other").to_pylist()):
            steps = [*siblings(tree, i), *above]
            proof.append(digest(x for step in steps for x in step).decode())
            folded.append(fold(own[i] if other is None else other.hex().encode(), steps).decode())
        same = lambda x: pa.array([x.decode()] * len(own), pa.string())
        return pa.table({
            "doc_id": table.column("id"), "source": table.column("group"), "leaf": pa.array([x.decode() for x in own], pa.string()), "subroot": same(subroot), "root": same(root),
            "proof_sha256": pa.array(proof, pa.string()), "folded_root": pa.array(folded, pa.string()), "verified": pa.array([x == root.decode() for x in folded], pa.bool_()),
        })

    return run


def manifest(
    docs: DataFrame, tampered: Column | None = None, id_col: str = "doc_id", group_col: str = "source", fields: Sequence[str] = FIELDS, text_col: str = "text", top: int = TOP, least_levels: int = LEAST_LEVELS
) -> DataFrame:
    """One row for each row of docs: doc_id, source, leaf, subroot, root, proof_sha256, folded_root, verified.

    A leaf is the digest of the fields, each `-` if null and else its number of bytes, a
    colon and the value. tampered: a condition on rows whose text is taken with A-Z in lower
    case when they are verified; a null text stays null, and where the condition is null or
    there is none, rows are verified as they are. proof_sha256 is the digest of the siblings
    from the leaf to the root; folded_root is made of the (tampered) leaf and the siblings
    of the tree as it was; verified says whether it is the root.

    Nulls: a null group is a group, the first; a null id comes before others. Rows that
    share an id follow each other by their leaf; rows that repeat as a whole are leaves
    each. An empty text is a value (`0:`), not null. Very long texts are digested where they
    are read. A single row is its group's root, and a single group's root is the root, with
    the digest of nothing as its proof. An empty table gives an empty result. Other columns
    are not read, whatever their names."""
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark, "manifest")
    values = [docs[c] for c in fields]
    lowered = [F.translate(docs[c], "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz") if c == text_col else docs[c] for c in fields]
    other = F.when(F.lit(False) if tampered is None else tampered, F.unhex(leaf(lowered)))
    rows = docs.select(docs[id_col].alias("id"), docs[group_col].alias("group"), F.unhex(leaf(values)).alias("leaf"), other.alias("other"))
    rows = scratch.save(rows, "leaves")  # the sort by ranges reads them twice: texts are read and digested once
    deep, n = least_levels, rows.count()
    while n > top * RUN**deep and deep < max(least_levels, MOST_LEVELS):
        deep += 1
    placed = scratch.save(numbered(scratch, rows, "group", ["id", "leaf"], "sorted"), "placed")
    scratch.drop("leaves", "sorted")
    block = F.expr(f"_idx div {RUN**deep}").alias("block")
    kind = {f.name: f.dataType.simpleString() for f in rows.schema}
    nodes = placed.select("group", "_idx", "_total", "leaf").groupBy("group", block).applyInArrow(_reduce(deep), f"group {kind['group']}, block long, node binary")
    root, paths = upper_tree(tuple(r) for r in nodes.collect()) if n else (b"", {})
    finish = _finish(deep, root, spark.sparkContext.broadcast(paths))
    return placed.groupBy("group", block).applyInArrow(finish, OUT.format(id=kind["id"], group=kind["group"]))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = manifest(docs, tampered=F.crc32(F.col("doc_id").cast("string")) % 5 == 0)
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


ORACLE = r"""
WITH RECURSIVE crc(tab) AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))
), d AS (
  SELECT *, row_number() OVER (ORDER BY doc_id) AS r,
         CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(doc_id::varchar) || ':' || doc_id END || CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END ||
         CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END || CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(n_chars::varchar) || ':' || n_chars END AS head,
         xor(list_reduce(list_concat([4294967295], list_transform(string_split(doc_id::varchar, ''), lambda x: ascii(x)::bigint)), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) AS c
  FROM documents, crc
), h AS (
  SELECT r, doc_id, source, sha256(head || CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END) AS leaf,
         CASE WHEN c % 5 = 0 THEN sha256(head || CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') END) END AS other
  FROM d
), s AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id, leaf) - 1 AS idx, count(*) OVER (PARTITION BY source) AS n FROM h
), tree(source, level, idx, n, node) AS (
  SELECT source, 0, idx, n, leaf FROM s
  UNION ALL
  SELECT source, level + 1, idx // 16, (n + 15) // 16, sha256(string_agg(node, '' ORDER BY idx)) FROM tree WHERE n > 1 GROUP BY source, level, n, idx // 16
), sub AS (
  SELECT source, node, row_number() OVER (ORDER BY source IS NOT NULL, encode(source)) - 1 AS idx, count(*) OVER () AS n FROM tree WHERE n = 1
), top(level, idx, n, node) AS (
  SELECT 0, idx, n, node FROM sub
  UNION ALL
  SELECT level + 1, idx // 16, (n + 15) // 16, sha256(string_agg(node, '' ORDER BY idx)) FROM top WHERE n > 1 GROUP BY level, n, idx // 16
), runs AS (
  SELECT source, level, idx // 16 AS run, list(node ORDER BY idx) AS nodes FROM tree WHERE n > 1 GROUP BY ALL
), top_runs AS (
  SELECT level, idx // 16 AS run, list(node ORDER BY idx) AS nodes FROM top WHERE n > 1 GROUP BY ALL
), up(r, source, level, idx, folded, proof) AS (
  SELECT r, source, 0, idx, coalesce(other, leaf), '' FROM s
  UNION ALL
  SELECT r, up.source, up.level + 1, idx // 16, sha256(array_to_string(nodes[:idx % 16], '') || folded || array_to_string(nodes[idx % 16 + 2:], '')),
         proof || array_to_string(nodes[:idx % 16], '') || array_to_string(nodes[idx % 16 + 2:], '')
  FROM up JOIN runs ON up.source IS NOT DISTINCT FROM runs.source AND up.level = runs.level AND up.idx // 16 = runs.run
), at_sub AS (
  SELECT r, source, folded, proof FROM up QUALIFY row_number() OVER (PARTITION BY r ORDER BY level DESC) = 1
), further(r, level, idx, folded, proof) AS (
  SELECT r, 0, sub.idx, folded, proof FROM at_sub JOIN sub ON at_sub.source IS NOT DISTINCT FROM sub.source
  UNION ALL
  SELECT r, further.level + 1, idx // 16, sha256(array_to_string(nodes[:idx % 16], '') || folded || array_to_string(nodes[idx % 16 + 2:], '')),
         proof || array_to_string(nodes[:idx % 16], '') || array_to_string(nodes[idx % 16 + 2:], '')
  FROM further JOIN top_runs ON further.level = top_runs.level AND further.idx // 16 = top_runs.run
), done AS (
  SELECT r, folded, sha256(proof) AS proof_sha256 FROM further QUALIFY row_number() OVER (PARTITION BY r ORDER BY level DESC) = 1
)
SELECT s.doc_id, s.leaf, sub.node AS subroot, (SELECT node FROM top WHERE n = 1) AS root, proof_sha256, folded AS folded_root, folded = (SELECT node FROM top WHERE n = 1) AS verified
FROM s JOIN done USING (r) JOIN sub ON s.source IS NOT DISTINCT FROM sub.source
"""
