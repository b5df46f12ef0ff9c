"""Resharding by minimum-cost flow: new shards of given capacities, reached by moving the fewest bytes.

The network has a source, the old shards with their sizes, the new shards with their
capacities, a sink, and a hub: what stays goes from a shard to itself at no cost, what
moves goes through the hub at a cost of 1 a byte. Successive shortest paths solve it;
the hub's flow is taken apart into transfers from shard to shard. Blocks of rows (those
of one old shard and size) then fulfil the transfers, the largest first, each to where
most is still missing, so that what is left over is about one small row.

Then files are rewritten: those of shards that give rows, without these; shards that take
rows get further files. Rows that repeat id and text are one row with a number until the
end, so that no group of them is held by one task.
"""

from __future__ import annotations

import heapq
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from sparkronym.llm.common import Scratch, names, ship
from sparkronym.llm.sieve import Sieve

LAWS = ("bytes", "rows", "key")


def min_cost_flow(n: int, edges: list[tuple[int, int, int, int]], s: int, t: int) -> list[int]:
    """The flow on each edge (from, to, capacity, cost) of a maximum flow of least cost, by successive shortest paths."""
    to, cap, cost, out = [], [], [], [[] for _ in range(n)]
    for a, b, c, w in edges:
        for x, y, k, z in ((a, b, c, w), (b, a, 0, -w)):
            out[x].append(len(to))
            to.append(y)
            cap.append(k)
            cost.append(z)
    potential = [0] * n
    while True:
        dist, via = [None] * n, [-1] * n
        dist[s], heap = 0, [(0, s)]
        while heap:
            d, x = heapq.heappop(heap)
            if d > dist[x]:
                continue
            for e in out[x]:
                if cap[e] > 0:
                    y, new = to[e], d + cost[e] + potential[x] - potential[to[e]]
                    if dist[y] is None or new < dist[y]:
                        dist[y], via[y] = new, e
                        heapq.heappush(heap, (new, y))
        if dist[t] is None:
            return [cap[2 * k + 1] for k in range(len(edges))]
        potential = [p + (d if d is not None else 0) for p, d in zip(potential, dist, strict=True)]
        path, x = [], t
        while x != s:
            path.append(via[x])
            x = to[via[x] ^ 1]
        push = min(cap[e] for e in path)
        for e in path:
            cap[e] -= push
            cap[e ^ 1] += push


def transfers(old: list[int], new: list[int]) -> dict[tuple[int, int], int]:
    """(from, to) -> amount, stays included; sums by row are old's, by column new's. Their totals must agree."""
    if sum(old) != sum(new):
        raise ValueError("old sizes and new capacities have different sums")
    a, b = len(old), len(new)
    s, hub, t = a + b, a + b + 1, a + b + 2
    edges = [(s, i, x, 0) for i, x in enumerate(old)] + [(i, a + i, min(old[i], new[i]), 0) for i in range(min(a, b))]
    k = len(edges)
    edges += [(i, hub, x, 1) for i, x in enumerate(old)] + [(hub, a + j, x, 0) for j, x in enumerate(new)]
    edges += [(a + j, t, x, 0) for j, x in enumerate(new)]
    flow = min_cost_flow(a + b + 3, edges, s, t)
    out = {(i, i): f for i, f in enumerate(flow[a:k]) if f}
    give = [[i, f] for i, f in enumerate(flow[k : k + a]) if f]
    take = [[j, f] for j, f in enumerate(flow[k + a : k + a + b]) if f]
    while give and take:
        f = min(give[-1][1], take[-1][1])
        key = (give[-1][0], take[-1][0])
        out[key] = out.get(key, 0) + f
        for side in (give, take):
            side[-1][1] -= f
            if not side[-1][1]:
                side.pop()
    return out


def capacities(total: int, n: int) -> list[int]:
    return [total // n + (j < total % n) for j in range(n)]


def _deal(moves: dict[tuple[int, int], int]):
    """A function that says for an old shard's sizes, from the largest on, how many rows of each go where."""

    def deal(key, rows):
        import pandas as pd

        old = int(key[0])
        need = {j: f for (i, j), f in moves.items() if i == old}
        out = []
        for m, n in sorted(zip(rows["m"].tolist(), rows["n"].tolist(), strict=True), reverse=True):
            left, whole = n, max(1, sum(max(0, f) for f in need.values()))
            got = {}
            for j, f in need.items():  # most of many equal rows in proportion, the rest one by one
                got[j] = min(left, max(0, f) // m, n * max(0, f) // whole) if n > 64 else 0
                left -= got[j]
                need[j] = f - got[j] * m
            heap = [(-f, j != old, j) for j, f in need.items()]
            heapq.heapify(heap)
            while left:
                f, moved, j = heap[0]
                # a full share at a time where rows are small against what is missing
                k = max(1, min(left // (2 * len(heap)), int(-f) // (2 * m)))
                got[j] += k
                left -= k
                need[j] -= k * m
                heapq.heapreplace(heap, (-need[j], moved, j))
            at = 0
            for j in sorted(got):
                if got[j]:
                    out.append((old, m, at, at + got[j], j))
                    at += got[j]
        return pd.DataFrame(out, columns=["old", "m", "lo", "hi", "shard"])

    return deal


#: Rows with one block number, about; blocks are numbered one by one.
BLOCK_ROWS, MOST_BLOCKS = 800, 1 << 16
#: What tells rows apart here; rows that agree in it are alike.
ROW = ["_id", "text_crc32", "size", "old_shard"]


def _numbered(rows: DataFrame, blocks: int, by: list[str], name: str) -> DataFrame:
    """rows (ROW and c) with the number of copies that come before in the same values of by, in an order of the ids' hashes.

    Counted by blocks of ids, then inside of each."""
    b = rows.withColumn("_b", F.pmod(F.xxhash64("_id", "text_crc32"), F.lit(blocks)))
    per = b.groupBy(*by, "_b").agg(F.sum("c").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy(*by).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    per = per.withColumn("_before", before).drop("_n")
    order = [F.xxhash64(F.lit(1), "_id"), F.col("_id"), F.col("text_crc32"), F.col("size"), F.col("old_shard")]
    inside = F.coalesce(F.sum("c").over(W.partitionBy(*by, "_b").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return b.withColumn("_in", inside).join(per, [*by, "_b"]).withColumn(name, F.col("_before") + F.col("_in")).drop("_b", "_in", "_before")


def _described(docs: DataFrame, id_col: str, text_col: str, old: Column) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).alias("_id"), F.crc32(text).alias("text_crc32"), (F.octet_length(text) + 1).cast("long").alias("size"), old.cast("int").alias("old_shard"))


def _blocks(rows: DataFrame) -> int:
    return int(min(MOST_BLOCKS, max(16, rows.count() // BLOCK_ROWS)))


def plan(scratch: Scratch, docs: DataFrame, n_new: int, law: str, old: Column, n_old: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """ROW, shard, grown_shard and c: how many rows that are alike go from their old shard to which."""
    rows = scratch.save(_described(docs, id_col, text_col, old).groupBy(*ROW).agg(F.count("*").alias("c")), "rows")
    if law == "key":
        own = lambda n: F.array_max(F.array(*(F.struct(F.xxhash64(F.lit("shard"), "_id", F.lit(j)).alias("h"), F.lit(j).alias("j")) for j in range(n))))["j"]
        return scratch.save(rows.withColumn("shard", own(n_new)).withColumn("grown_shard", own(n_new + 1)), "plan")
    m = F.col("size") if law == "bytes" else F.lit(1).cast("long")
    rows = rows.withColumn("m", m)
    held = {r["old_shard"]: int(r["m"]) for r in rows.groupBy("old_shard").agg(F.sum(F.col("m") * F.col("c")).alias("m")).collect()}
    sizes = [held.get(i, 0) for i in range(n_old)]
    moves = transfers(sizes, capacities(sum(sizes), n_new))
    groups = rows.groupBy(F.col("old_shard").alias("old"), "m").agg(F.sum("c").alias("n"))
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("old", "m", "lo", "hi", "shard")])
    dealt = scratch.save(groups.groupBy("old").applyInPandas(_deal(moves), schema), "dealt")
    # of equal size, rows are numbered; a range of numbers goes to a shard
    ranges = dealt.groupBy(F.col("old").cast("int").alias("old_shard"), "m").agg(F.collect_list(F.struct("lo", "hi", "shard")).alias("to"))
    ranges = scratch.save(ranges, "ranges")
    at = _numbered(rows, _blocks(rows), ["old_shard", "m"], "at").join(ranges, ["old_shard", "m"])
    part = F.transform("to", lambda x: F.struct(x["shard"].cast("int").alias("shard"), (F.least(x["hi"], F.col("at") + F.col("c")) - F.greatest(x["lo"], F.col("at"))).alias("c")))
    out = at.select(*ROW, F.explode(F.filter(part, lambda x: x["c"] > 0)).alias("p")).select(*ROW, "p.shard", F.lit(None).cast("int").alias("grown_shard"), "p.c")
    return scratch.save(out, "plan")


def _slots(scratch: Scratch, rows: DataFrame, law: str, id_col: str) -> DataFrame:
    """A row for each of c alike, with slots that count from 0 in each shard."""
    rows = scratch.save(_numbered(rows, _blocks(rows), ["shard"], "at"), "placed")
    step = 1024  # rows that are alike come back in portions, so that no array is as long as a group
    out = rows.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("c") - 1) / step))))
    out = out.withColumn("_i", F.explode(F.sequence(F.col("_k") * step, F.least(F.col("c"), (F.col("_k") + 1) * step) - 1)))
    return out.select(F.col("_id").alias(id_col), "size", "text_crc32", F.lit(law).alias("law"), "old_shard", "shard", (F.col("at") + F.col("_i")).alias("slot"), "grown_shard")


def reshard(
    docs: DataFrame, n_new: int, law: str = "bytes", old=None, n_old: int | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of docs: id, size, text_crc32, law, old_shard, shard, slot, grown_shard.

    bytes: shards' sizes as equal as whole rows allow; rows: their counts at most one
    apart; both by moving the fewest bytes (rows) out of the old shards, a column of
    integers from 0 to n_old - 1 (null: rows are dealt to n_old shards by a hash of
    the id). key: the shard is that of 0 to n_new - 1 with the greatest hash of id and
    shard, so that id and count decide, and a further shard takes rows only into itself
    (grown_shard); old shards then don't matter.
    size is the UTF-8 bytes of the text plus 1; a null text has 1, and crc 0. Null ids are
    ids like others. Repeated rows each get their slot; ties of the order are broken by
    id, crc and size. An empty table gives an empty result. Other columns are not read,
    whatever their names. Slots count from 0 in each shard without gaps.
    Tables on the driver have a row for each old and new shard; all else is counted,
    summed and numbered by blocks, of which a group of equal texts has many."""
    if law not in LAWS:
        raise ValueError(f"law is one of {LAWS}")
    ship(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "sharding")
    n_old = n_old or n_new
    placed = plan(scratch, docs, n_new, law, dealt_by_id(id_col, n_old) if old is None else F.col(old), n_old, id_col, text_col)
    out = _slots(scratch, placed, law, id_col)
    scratch.drop(*(x for x in scratch.names if x != "placed"))
    return out


def dealt_by_id(id_col: str, n: int) -> Column:
    return F.pmod(F.xxhash64(F.lit("old"), id_col), F.lit(n)).cast("int")


def store(docs: DataFrame, root: str, shard: Column, shard_col: str = "shard") -> None:
    """Writes docs into root/<shard_col>=N; docs may not have a column of that name."""
    docs.withColumn(shard_col, shard).write.option("compression", "zstd").partitionBy(shard_col).parquet(root)


def read_store(spark: SparkSession, root: str, schema: T.StructType, shard_col: str = "shard") -> DataFrame:
    return spark.read.schema(T.StructType([*(f for f in schema if f.name != shard_col), T.StructField(shard_col, T.IntegerType())])).parquet(root)


def rewrite(spark: SparkSession, root: str, schema: T.StructType, placed: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_col: str = "shard") -> list[int]:
    """Moves rows between the shards of a store, rewriting only files that this affects; returns the shards that rows enter or leave.

    placed: the plan for the rows of root (schema: without or with shard_col). Shards that
    give rows are written anew without them, those that take rows get further files, all
    others stay as they are. New files are written beside the shards, in the store itself;
    then givers' old folders are renamed aside, the new files renamed in, and the store's
    rows counted. Only then old files are deleted. Whatever fails before is undone: the
    store is as it was, or, where undoing fails too, an error names the folders that hold
    all rows, and recover() puts them back. Most rows that stay never meet the plan: it is asked, in a join, only for
    rows that pass a sieve of those that move. Null ids are ids like others; of rows that
    repeat id and text, as many go as the plan says. Rows of a null shard stay.
    Columns of any name but shard_col are kept as they are."""
    ship(spark)
    scratch = Scratch(spark, "rewrite")
    moves = placed.where("old_shard <> shard")
    pairs = [tuple(r) for r in moves.select("old_shard", "shard").distinct().collect()]  # at most old times new shards
    givers, takers = sorted({i for i, _ in pairs}), sorted({j for _, j in pairs})
    if not pairs:
        return []
    keys = moves.select(*ROW).distinct()
    sieve = Sieve(keys.select(F.xxhash64("_id", "text_crc32").alias("key")), keys.count())

    @F.pandas_udf("boolean")
    def passes(key: pd.Series) -> pd.Series:
        return pd.Series(sieve.passes(key.to_numpy()))

    rows = read_store(spark, root, schema, shard_col).where(F.col(shard_col).isin(givers))
    key, row, at, copies, num, k, to = names(rows, "key", "row", "at", "copies", "num", "k", "to")
    crc = F.crc32(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    asked = rows.withColumn(key, passes(F.xxhash64(F.col(id_col), crc)))
    stay = asked.where(~F.col(key)).drop(key)
    # the others, numbered among rows that are alike: by portions of them, then inside of each
    size = F.octet_length(F.coalesce(F.col(text_col).cast("string"), F.lit(""))) + 1
    own = F.struct(F.col(id_col).alias("_id"), crc.alias("text_crc32"), size.cast("long").alias("size"), F.col(shard_col).alias("old_shard"))
    asked = scratch.save(asked.where(key).withColumn(key, own).withColumn(row, F.monotonically_increasing_id()).withColumn(at, F.shiftright(F.col(row), 10)), "asked")
    portion = asked.groupBy(key, at).agg(F.count("*").alias(num))
    before = F.coalesce(F.sum(num).over(W.partitionBy(key).orderBy(at).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    portion = scratch.save(portion.select(F.col(key).alias(k), F.col(at).alias(copies), before.alias(to)), "portions")
    light = asked.select(key, row, at).withColumn(num, F.row_number().over(W.partitionBy(key, at).orderBy(row)) - 1)
    numbered = light.join(portion, F.col(key).eqNullSafe(F.col(k)) & (F.col(at) == F.col(copies))).withColumn(num, F.col(num) + F.col(to)).drop(k, copies, to)
    targets = placed.groupBy(F.struct(*ROW).alias("k")).agg(F.array_sort(F.collect_list(F.struct("shard", "c"))).alias("to"), F.max(F.col("old_shard") != F.col("shard")).alias("moves")).where("moves")
    upto = F.transform("to", lambda x, i: F.struct(F.aggregate(F.slice("to", F.lit(1), i + 1), F.lit(0).cast("long"), lambda s, y: s + y["c"]).alias("hi"), x["shard"].alias("shard")))
    targets = scratch.save(targets.select(F.col("k").alias(k), upto.alias(to)), "targets")
    found = numbered.join(targets, F.col(key).eqNullSafe(F.col(k))).select(F.col(row).alias(k), F.filter(to, lambda x: x["hi"] > F.col(num))[0]["shard"].alias(copies))
    found = scratch.save(found, "found")
    # texts meet their new shards once, and by the same kind of join at every size
    went = asked.drop(key, at).join(found.hint("merge"), F.col(row) == F.col(k), "left").withColumn(shard_col, F.coalesce(copies, shard_col)).select(*rows.columns)
    total = read_store(spark, root, schema, shard_col).count()
    aside = f"{root}/_rewrite-{uuid.uuid4().hex}"
    try:
        stay.unionByName(went).write.option("compression", "zstd").partitionBy(shard_col).parquet(f"{aside}/new")
        _swap(_Files(spark, root), root, aside, shard_col, givers, takers, lambda: read_store(spark, root, schema, shard_col).count() == total)
    finally:
        scratch.close()
    return sorted({*givers, *takers})


class _Files:
    """Renames and deletes that fail loudly."""

    def __init__(self, spark: SparkSession, root: str):
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def names(self, path: str) -> list[str]:
        return sorted(f.getPath().getName() for f in self._fs.listStatus(self._path(path))) if self.exists(path) else []

    def make(self, path: str) -> None:
        if not self._fs.mkdirs(self._path(path)):
            raise OSError(f"{path}: can't be made")

    def rename(self, old: str, new: str) -> None:
        if not self._fs.rename(self._path(old), self._path(new)):
            raise OSError(f"{old}: can't be renamed to {new}")

    def delete(self, path: str) -> None:
        if self.exists(path) and not self._fs.delete(self._path(path), True):
            raise OSError(f"{path}: can't be deleted")


def _swap(files: _Files, root: str, aside: str, shard_col: str, givers: list[int], takers: list[int], complete) -> None:
    """Puts the files of aside/new into the store and givers' old folders into aside/old, or leaves all as it was."""
    try:
        files.make(f"{aside}/old")
        for j in givers:
            if files.exists(f"{root}/{shard_col}={j}"):
                files.rename(f"{root}/{shard_col}={j}", f"{aside}/old/{shard_col}={j}")
        for j in sorted({*givers, *takers}):
            new = f"{aside}/new/{shard_col}={j}"
            if files.exists(new):
                if not files.exists(f"{root}/{shard_col}={j}"):
                    files.make(f"{root}/{shard_col}={j}")
                files.make(f"{aside}/in/{shard_col}={j}")  # what has gone in, by name, for whoever has to undo it
                for f in files.names(new):
                    files.make(f"{aside}/in/{shard_col}={j}/{f}")
                    files.rename(f"{new}/{f}", f"{root}/{shard_col}={j}/{f}")
        if not complete():
            raise OSError(f"{root}: rows are missing or too many after shards were rewritten")
    except BaseException as e:
        try:
            _undo(files, root, aside)
        except Exception as again:  # noqa: BLE001 said with the first
            raise OSError(f"{aside}: holds rows of {root}; recover() puts them back ({again})") from e
        raise
    files.make(f"{aside}/done")
    files.delete(aside)


def _undo(files: _Files, root: str, aside: str) -> None:
    if not files.exists(f"{aside}/done"):
        for shard in files.names(f"{aside}/in"):
            for f in files.names(f"{aside}/in/{shard}"):
                files.delete(f"{root}/{shard}/{f}")
        for shard in files.names(f"{aside}/old"):
            files.delete(f"{root}/{shard}")  # only new files were in it, and they are gone
            files.rename(f"{aside}/old/{shard}", f"{root}/{shard}")
    files.delete(aside)


def recover(spark: SparkSession, root: str) -> int:
    """Puts back what rewrites that were cut off (the driver died) left in a store; returns how many there were."""
    files = _Files(spark, root)
    cut = [f for f in files.names(root) if f.startswith("_rewrite-")]
    for f in cut:
        _undo(files, root, f"{root}/{f}")
    return len(cut)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents from 12 old shards into 16 of near equal bytes: written, planned, rewritten and read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    scratch = Scratch(spark, "op8")
    root = scratch.path("shards")
    store(docs, root, dealt_by_id("doc_id", 12))
    held = read_store(spark, root, docs.schema)
    placed = plan(scratch, held, 16, "bytes", F.col("shard"), 12)
    rewrite(spark, root, docs.schema, placed)
    back = _described(read_store(spark, root, docs.schema), "doc_id", "text", F.col("shard")).withColumn("shard", F.col("old_shard"))
    back = back.groupBy(*ROW, "shard").agg(F.count("*").alias("c")).withColumn("grown_shard", F.lit(None).cast("int"))
    out = _slots(scratch, scratch.save(back, "back"), "bytes", "doc_id").drop("old_shard")
    scratch.drop("shards", *(x for x in scratch.names if x != "placed"))
    return out
