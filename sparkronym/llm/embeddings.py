"""Near-duplicates among vectors by an epsilon grid order join.

Vectors of length 1 with cosine >= c are at most sqrt(2 - 2c) =: eps apart. All are
turned to their leading principal directions; cells of side eps in the first of these
give an order of cells, in which the vectors are sorted and cut into blocks of a sequence.
Two intervals of the sequence can hold linked vectors only if the boxes around their
turned coordinates are at most eps apart; intervals are joined recursively, by fans of
FAN blocks down to single blocks and inside of these to leaves, and left out as soon
as their boxes are too far from each other. Leaves are compared by the cosine of the
vectors themselves, in double precision.

Equal vectors are folded before, with their number. Blocks are
compared in tiles of many by many, so that a vector is sent to few tasks; a tile gives for each
vector the number of its links and a spanning forest of the links, not the links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkronym.llm import words as w
from sparkronym.llm.common import Scratch, ship
from sparkronym.llm.graph import components

#: Principal directions that boxes have, and of these in the cells of the order.
DIRECTIONS, CELL_DIRECTIONS = 16, 4
#: Bytes of a block's vectors, its rows at most, rows of a leaf, and blocks in an interval one level up.
BLOCK_BYTES, BLOCK_ROWS, LEAF, FAN = 1 << 19, 2048, 256, 16
#: Blocks on a side of a tile at most, and sides that the sequence has at least, if it has as many blocks.
TILE, SIDES = 32, 7
#: Readings of the vectors by which the directions are found.
PASSES = 4
SLACK = 1e-7


def matrix(col: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.float64).reshape(-1, dim)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors as bytes of doubles; null where they link with nothing."""
    for batch in batches:
        out = []
        for v in batch.column(1):
            x = None
            if v.is_valid:
                a = v.values
                if a.null_count == 0 and len(a):
                    x = np.asarray(a.to_numpy(zero_copy_only=False), np.float64) + 0.0  # -0 is 0
                    x = x.tobytes() if np.isfinite(x).all() and x.any() else None
            out.append(x)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["vec_id", "v"])


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # no overflow of squares
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _moments(dim: int, q: np.ndarray):
    """The part of a partition in the second moments times q."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = np.zeros(q.shape)
        for batch in batches:
            x = unit(matrix(batch.column(0), dim)) if len(batch) else np.zeros((0, dim))
            s += x.T @ (x @ q)
        yield pa.RecordBatch.from_arrays([pa.array([s.tobytes()], pa.binary())], names=["m"])

    return w.tidy(run)


def _add(rows):
    import pandas as pd

    return pd.DataFrame({"m": [np.sum([np.frombuffer(m) for m in rows["m"]], 0).tobytes()]})


def basis(vectors: DataFrame, dim: int) -> np.ndarray:
    """The leading principal directions as columns, by PASSES block power steps, of which each reads the vectors once
    and adds up a matrix of dim times as many directions. Any orthonormal columns would give right results."""
    q = np.linalg.qr(np.random.default_rng(0).normal(size=(dim, min(DIRECTIONS, dim))))[0]
    for _ in range(PASSES):
        m = vectors.select("v").mapInArrow(_moments(dim, q), "m binary")
        m = m.withColumn("g", F.shiftright(F.monotonically_increasing_id(), 33) % 64).groupBy("g").applyInPandas(_add, "m binary")
        total = sum((np.frombuffer(r[0]).reshape(q.shape) for r in m.collect()), np.zeros(q.shape))
        q = np.linalg.qr(total + 1e-12 * q)[0]
    return q


def _turned(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Coordinates of vectors of length 1 in the directions, and the length of what these leave out: it differs by no
    more than vectors do, which is one more side of the boxes."""
    z = x @ q
    return np.column_stack((z, np.sqrt(np.maximum(0, 1 - (z * z).sum(1)))))


def _short(x: np.ndarray) -> bytes:
    """The numbers as floats if these are the same, else as doubles."""
    with np.errstate(over="ignore", under="ignore"):
        y = x.astype(np.float32)
    return y.tobytes() if (y == x).all() else x.tobytes()


def _place(dim: int, q: np.ndarray, eps: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = _turned(unit(matrix(batch.column(2), dim)) if len(batch) else np.zeros((0, dim)), q)
            c = np.floor(z[:, :CELL_DIRECTIONS] / eps).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(list(c), pa.list_(pa.int64())), pa.array(z[:, 0]), pa.array([r.tobytes() for r in z], pa.binary())],
                names=["row", "copies", "v", "cell", "first", "z"],
            )

    return w.tidy(run)


def _blocks(most: int, q: int):
    """Blocks of the sequence of a partition: members, numbers, vectors, and the box around them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []

        def cut(rows):
            t = pa.Table.from_batches(rows).combine_chunks()
            z = np.frombuffer(b"".join(t["z"].to_pylist()), np.float64).reshape(-1, q)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([t["row"].to_numpy().tobytes()], pa.binary()), pa.array([t["copies"].to_numpy().tobytes()], pa.binary()),
                    pa.array([_short(np.frombuffer(b"".join(t["v"].to_pylist())))], pa.binary()),
                    pa.array([z.min(0).tolist()], pa.list_(pa.float64())), pa.array([z.max(0).tolist()], pa.list_(pa.float64())),
                ],
                names=["rows", "copies", "v", "lo", "hi"],
            )

        n = 0
        for batch in batches:
            while len(batch):
                take = batch.slice(0, most - n)
                held.append(take)
                n += len(take)
                batch = batch.slice(len(take))
                if n == most:
                    yield cut(held)
                    held, n = [], 0
        if n:
            yield cut(held)

    return w.tidy(run)


def far(lo_a, hi_a, lo_b, hi_b, eps: float) -> bool:
    gap = np.maximum(0, np.maximum(lo_a - hi_b, lo_b - hi_a))
    return float((gap * gap).sum()) > (eps + SLACK) ** 2


def near_pairs(boxes: DataFrame, eps: float, scratch: Scratch) -> DataFrame:
    """(i, j), i <= j, of blocks whose boxes are near: from the whole sequence down, a level of intervals at a time."""
    n = boxes.agg(F.coalesce(F.max("block"), F.lit(-1))).first()[0] + 1
    levels = [boxes.select("block", "lo", "hi")]
    while n > FAN:
        up = levels[-1].select((F.col("block") / FAN).cast("long").alias("block"), F.posexplode(F.arrays_zip("lo", "hi")).alias("k", "x"))
        up = up.groupBy("block", "k").agg(F.min("x.lo").alias("l"), F.max("x.hi").alias("h")).groupBy("block").agg(F.array_sort(F.collect_list(F.struct("k", "l", "h"))).alias("b"))
        levels.append(scratch.save(up.select("block", F.col("b.l").alias("lo"), F.col("b.h").alias("hi")), f"level{len(levels)}"))
        n = -(-n // FAN)
    gap = F.aggregate(
        F.zip_with(F.zip_with("lo_i", "hi_j", lambda a, b: a - b), F.zip_with("lo_j", "hi_i", lambda a, b: a - b), lambda a, b: F.greatest(F.lit(0.0), a, b)),
        F.lit(0.0), lambda s, x: s + x * x,
    )
    pairs = None
    for depth in reversed(range(len(levels))):
        box = levels[depth]
        if pairs is None:
            cand = box.sparkSession.range(n).select(F.col("id").alias("i"))  # FAN at most
            cand = cand.select("i", F.explode(F.sequence(F.col("i"), F.lit(n - 1).cast("long"))).alias("j"))
        else:
            below = lambda c: F.explode(F.sequence(F.col(c) * FAN, F.col(c) * FAN + (FAN - 1))).alias(c)
            cand = pairs.select(below("i"), "j").select("i", below("j")).where("i <= j")
        cand = cand.join(box.select(F.col("block").alias("i"), F.col("lo").alias("lo_i"), F.col("hi").alias("hi_i")), "i")
        cand = cand.join(box.select(F.col("block").alias("j"), F.col("lo").alias("lo_j"), F.col("hi").alias("hi_j")), "j")
        pairs = scratch.save(cand.where(gap <= (eps + SLACK) ** 2).select("i", "j"), f"pairs{depth}")
    return pairs


def _roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest member of each vertex's component."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _join_tile(dim: int, q: np.ndarray, cosine: float, eps: float):
    """Pairs of blocks (i, j) of a tile, whose blocks it gets once each."""

    def run(blocks, pairs):
        import pandas as pd

        own, out = {}, []
        for r in blocks.itertuples():
            rows = np.frombuffer(r.rows, np.int64)
            x = unit(np.frombuffer(r.v, np.float32 if len(r.v) == len(rows) * dim * 4 else np.float64).reshape(-1, dim).astype(np.float64))
            own[r.block] = rows, np.frombuffer(r.copies, np.int64), x, _turned(x, q)
        for i, j in sorted(zip(pairs["i"], pairs["j"], strict=True)):
            out.append(_join_pair(own[i], own[j], i == j, cosine, eps))
        if not out:
            return pd.DataFrame({"x": [], "y": [], "c": []}, dtype=np.int64)
        return pd.concat(out).groupby(["x", "y"], as_index=False)["c"].sum()

    return run


def _join_pair(a, b, same: bool, cosine: float, eps: float):
    def run():
        import pandas as pd

        na, nb = len(a[0]), len(b[0])
        count_a, count_b = np.zeros(na, np.int64), np.zeros(nb, np.int64)
        ea, eb = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

        def intervals(i0, i1, j0, j1):
            if same and j1 <= i0:
                return
            za, zb = a[3][i0:i1], b[3][j0:j1]
            if far(za.min(0), za.max(0), zb.min(0), zb.max(0), eps):
                return
            if max(i1 - i0, j1 - j0) > LEAF:
                if i1 - i0 >= j1 - j0:
                    m = (i0 + i1) // 2
                    intervals(i0, m, j0, j1)
                    intervals(m, i1, j0, j1)
                else:
                    m = (j0 + j1) // 2
                    intervals(i0, i1, j0, m)
                    intervals(i0, i1, m, j1)
                return
            hit = a[2][i0:i1] @ b[2][j0:j1].T >= cosine
            if same:  # each pair once
                hit &= np.arange(i0, i1)[:, None] < np.arange(j0, j1)[None, :]
            x, y = np.nonzero(hit)
            if not len(x):
                return
            count_a[i0:i1] += (hit * b[1][j0:j1]).sum(1)
            count_b[j0:j1] += (hit * a[1][i0:i1, None]).sum(0)
            root = _roots(x, y + (i1 - i0), (i1 - i0) + (j1 - j0))
            both = np.concatenate((np.arange(i0, i1), (0 if same else na) + np.arange(j0, j1)))
            keep = np.flatnonzero(root != np.arange(len(root)))
            ea.append(both[keep])
            eb.append(both[root[keep]])

        intervals(0, na, 0, nb)
        if same:
            count_a += count_b
        ids = a[0] if same else np.concatenate((a[0], b[0]))
        x, y = np.concatenate(ea), np.concatenate(eb)
        root = _roots(x, y, len(ids))
        edge = np.flatnonzero(root != np.arange(len(ids)))
        counts = [(a[0], count_a)] + ([] if same else [(b[0], count_b)])
        out = [pd.DataFrame({"x": i[c > 0], "y": np.int64(-1), "c": c[c > 0]}) for i, c in counts]
        out.append(pd.DataFrame({"x": ids[edge], "y": ids[root[edge]], "c": np.int64(0)}))
        return pd.concat(out)

    return run()


def near_vectors(vectors: DataFrame, cosine: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per row of vectors: vec_id, n_links, component_id, kept.

    Vectors that are null, empty, zero or hold null or non-finite components link with
    nothing, and vectors of different lengths don't link. Repeated rows are rows: they
    link with each other, and of rows that share the smallest id one is kept. A null id
    is larger than all others. An empty table gives an empty result. Other columns are
    not read. cosine is in (0, 1]."""
    spark = vectors.sparkSession
    ship(spark)
    scratch = Scratch(spark, "embeddings")
    eps = float(np.sqrt(max(0.0, 2 - 2 * cosine)))
    src = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    kind = src.schema["vec_id"].dataType.simpleString()
    packed = scratch.save(src.mapInArrow(_pack, f"vec_id {kind}, v binary").withColumn("row", F.monotonically_increasing_id()), "packed")
    reps = packed.where("v is not null").groupBy("v").agg(F.min("row").alias("rep"), F.count("*").alias("copies"))
    reps = scratch.save(reps.select("rep", "copies", "v"), "reps")
    members = packed.join(reps.select("v", "rep", "copies"), "v", "left").select("row", "vec_id", F.coalesce("rep", "row").alias("rep"), F.coalesce("copies", F.lit(1)).alias("copies"))
    members = scratch.save(members, "members")
    scratch.drop("packed")

    found = None
    for (size,) in reps.select(F.length("v")).distinct().collect():  # one length, as a rule
        dim = size // 8
        own = reps.where(F.length("v") == size).select(F.col("rep").alias("row"), "copies", "v")
        q = basis(own, dim)
        most = max(64, min(BLOCK_ROWS, BLOCK_BYTES // dim // 8 * 2))
        placed = own.mapInArrow(_place(dim, q, eps), "row long, copies long, v binary, cell array<long>, first double, z binary")
        placed = scratch.save(placed, f"placed{dim}")
        want = max(1, -(-placed.count() // (4 * most)))
        order = placed.repartitionByRange(want, "cell", "first", "row").sortWithinPartitions("cell", "first", "row")
        blocks = order.select("row", "copies", "v", "z").mapInArrow(_blocks(most, q.shape[1] + 1), "rows binary, copies binary, v binary, lo array<double>, hi array<double>")
        blocks = scratch.save(blocks.withColumn("id", F.monotonically_increasing_id()), f"unnumbered{dim}")
        # ids ascend with the sequence; intervals need them without gaps, by the numbers of blocks of each partition
        parts = [r["p"] for r in blocks.groupBy(F.shiftright("id", 33).alias("p")).agg(F.count("*").alias("n")).orderBy("p").collect()]
        counts = {r["p"]: r["n"] for r in blocks.groupBy(F.shiftright("id", 33).alias("p")).agg(F.count("*").alias("n")).collect()}
        at, start = 0, []
        for p in parts:
            start.append((p, at))
            at += counts[p]
        first = spark.createDataFrame(start or [(0, 0)], "p long, at long")
        blocks = blocks.join(F.broadcast(first) if len(start) < 100_000 else first, F.shiftright("id", 33) == F.col("p")).withColumn("block", F.col("at") + F.col("id").bitwiseAND(F.lit((1 << 33) - 1))).drop("p", "at", "id")
        pairs = near_pairs(blocks.select("block", "lo", "hi"), eps, scratch)
        # a block goes once to each tile that uses it, not to each pair: copies of the vectors are as many as the tiles of a side
        side = max(1, min(TILE, -(-at // SIDES)))
        tile = lambda c: (F.col(c) / side).cast("long")
        uses = pairs.select(tile("i").alias("ti"), tile("j").alias("tj"), F.explode(F.array_distinct(F.array("i", "j"))).alias("block")).distinct()
        inside = pairs.select(tile("i").alias("pi"), tile("j").alias("pj"), "i", "j")
        tasks = uses.join(blocks.select("block", "rows", "copies", "v"), "block")
        tiles = tasks.groupBy("ti", "tj").cogroup(inside.groupBy("pi", "pj")).applyInPandas(_join_tile(dim, q, cosine, eps), "x long, y long, c long")
        got = scratch.save(tiles, f"found{dim}")
        found = got if found is None else found.unionByName(got)
        scratch.drop(f"placed{dim}", f"unnumbered{dim}")
    if found is None:
        found = spark.createDataFrame([], "x long, y long, c long")
    scratch.drop("reps")
    links = found.where("y = -1").groupBy("x").agg(F.sum("c").alias("c"))
    labels = components(found.where("y >= 0").select("x", "y"), scratch)
    lab = members.join(labels, members.rep == labels.v, "left").withColumn("label", F.coalesce("label", "rep")).drop("v")
    lab = lab.join(links, lab.rep == links.x, "left").select("row", "vec_id", "label", (F.coalesce("c", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    lab = scratch.save(lab, "labelled")
    least = lab.groupBy("label").agg(F.min(F.struct(F.col("vec_id").isNull().alias("null"), "vec_id", "row")).alias("s")).select("label", F.col("s.vec_id").alias("component_id"), F.col("s.row").alias("keeper"))
    return lab.join(least, "label").select("vec_id", "n_links", "component_id", (F.col("row") == F.col("keeper")).alias("kept"))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), u AS (
  SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM v
  WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), l AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND a.n > 0 AND b.n > 0
  WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.9
), r(v, w) AS (
  SELECT vec_id, vec_id FROM v UNION SELECT r.v, l.y FROM r JOIN l ON l.x = r.w
), c AS (
  SELECT v, min(w) AS component_id FROM r GROUP BY v
)
SELECT v.vec_id, (SELECT count(*) FROM l WHERE x = v.vec_id) AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v JOIN c ON c.v = v.vec_id
"""
