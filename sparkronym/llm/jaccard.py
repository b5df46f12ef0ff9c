"""Near-duplicate join on word shingles: which documents are linked, and in which components.

Two documents link when 100 * |A and B| >= percent * |A or B| of their sets of shingles.
Sets are named by 64-bit hashes of shingles, sorted.

1. Equal sets are folded: one representative each, with its members.
2. Which sets a tile need compare. Of a set of n shingles, any linked set shares at least
   ceil(percent * n / 100), so that in any common order of all shingles the two share one
   among their first n - that + 1. The order here: shingles that are in many sets come
   last, the others by their hashes; which are in many is counted over all sets. Sets that
   share such a shingle are a group. Sets that need a shingle of many sets for this are
   grouped by hashed buckets instead: by pigeonhole, two linked sets agree in all shingles
   of some bucket, as there are more buckets than shingles by which linked sets of that
   band of sizes can differ; documents that have such a bucket in common are a group, and
   a shared passage makes none.
3. Tiles. Sets are sorted by size and cut into blocks of bounded bytes; two blocks whose
   sizes may link are a tile, and all comparisons are made in tiles, whatever group they
   are of: a tile gets each set it needs once. First it gets bitmaps of hashed shingles,
   of about as many bits as shingles; |A xor B| is at least the number of bits that
   differ, which bounds the overlap from above. Of what passes it gets the sets, for the
   exact intersection of sorted arrays.
4. Each group is first compared with its first row, which joins most. Groups that are then
   still of several components are compared in full, in tiles again: small groups by
   their pairs, of large ones all rows whose components differ.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkronym.llm import words as w
from sparkronym.llm.common import Scratch, names, ship
from sparkronym.llm.graph import components
from sparkronym.llm.sieve import Sieve

#: Bits of the bitmap of a small set.
LEAST_BITS = 512
#: Bytes of the sets of a block of a tile; each counts as 2 KB at least.
TILE_BYTES = 1 << 22
#: A shingle that is among the first ones of more sets than this comes last in the order ...
MANY = 16
#: ... of which the driver and each worker hold so many at most, the most frequent.
MOST_HOT = 1 << 20
U = np.uint64


def least_overlap(n: int, percent: int) -> int:
    return -(-percent * n // 100)


def prefix(n: int, percent: int) -> int:
    return n - least_overlap(n, percent) + 1


def shingle_sets(column: pa.Array, k: int) -> list[np.ndarray]:
    """The sorted distinct shingles of each text, as hashes; of fewer than k words, the whole sequence as one."""
    data, off = w.text_bytes(column)
    data = w.LOWER[data]
    starts, ends, of = w.spans(data, off)
    word = w.hashes(data, starts, ends)
    full = w.runs(word, k)
    out = []
    for a, b in zip(of[:-1].tolist(), of[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(full[a : b - k + 1]))
        elif b > a:
            out.append(w.runs(word[a:b], b - a, 1000 + b - a))
        else:
            out.append(np.zeros(0, U))
    return out


def _digests(sets: list[np.ndarray]) -> list[pa.Array]:
    """128 bits of each set."""
    return [pa.array(np.array([np.add.reduce(w.mix(x)) for x in some], U).view(np.int64)) for some in ([s + U(11) for s in sets], [s ^ U(0x5851F42D4C957F2D) for s in sets])]


def _sets(k: int, percent: int):
    """Per row: size, 128 bits of the set, its first shingles by hash, and its bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in w.slices(batch, "text"):
                sets = shingle_sets(part.column(1), k)
                first = [s[: max(64, 2 * prefix(len(s), percent) + 10)].tobytes() for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(list(map(len, sets)), pa.int64()), *_digests(sets), pa.array(first, pa.binary()), pa.array(list(map(bitmap, sets)), pa.binary())],
                    names=["doc_id", "n", "s1", "s2", "first", "bitmap"],
                )

    return w.tidy(run)


def _whole(k: int, sieve: Sieve):
    """The sets of rows whose key (third column) passes the sieve."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = batch.take(pa.array(np.flatnonzero(sieve.passes(batch.column(2).to_numpy()))))
            for part in w.slices(some, "text"):
                sets = shingle_sets(part.column(1), k)
                yield pa.RecordBatch.from_arrays([part.column(0), *_digests(sets), pa.array([s.tobytes() for s in sets], pa.binary())], names=["_id", "s1", "s2", "shingles"])

    return w.tidy(run)


def _count(shards: int):
    """Counts of shingles in a batch of sets, by range of the hash: their upper 40 bits, and up to 255."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t, n = np.unique(np.frombuffer(b"".join(batch.column(0).to_pylist()), U) >> U(24), return_counts=True)
            shard = ((t >> U(8)) * U(shards) >> U(32)).astype(np.int64)
            cuts = np.flatnonzero(np.diff(shard)) + 1
            rows = [(int(s[0]), x, m) for s, x, m in zip(np.split(shard, cuts), np.split(t, cuts), np.split(n, cuts), strict=True) if len(s)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in rows], pa.int64()),
                    pa.array([r[1].view(np.uint8).reshape(-1, 8)[:, :5].tobytes() for r in rows], pa.binary()),
                    pa.array([np.minimum(r[2], 255).astype(np.uint8).tobytes() for r in rows], pa.binary()),
                ],
                names=["shard", "tokens", "counts"],
            )

    return run


def _hot(many: int):
    """The shingles of a range that are in more than so many sets, by the logarithm of how many."""

    def run(rows):
        import pandas as pd

        t = np.frombuffer(b"".join(rows["tokens"]), np.uint8).reshape(-1, 5)
        full = np.zeros((len(t), 8), np.uint8)
        full[:, :5] = t
        x, at = np.unique(full.view(U).ravel(), return_inverse=True)
        n = np.bincount(at, np.frombuffer(b"".join(rows["counts"]), np.uint8), len(x))
        x, level = x[n > many], np.log2(n[n > many]).astype(np.int64)
        return pd.DataFrame([(v, int((level == v).sum()), x[level == v].tobytes()) for v in np.unique(level).tolist()], columns=["level", "n", "tokens"])

    return run


def _prefixes(percent: int, hot, with_all: bool):
    """Per set its first shingles in the order, cold and hot ones; short: more of the set is needed to tell them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = np.frombuffer(hot.value, U)
        for batch in batches:
            cold_out, hot_out, short = [], [], []
            for n, first in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                s = np.frombuffer(first, U)
                p = prefix(n, percent)
                is_hot = np.zeros(len(s), bool)
                if len(last):
                    key = s >> U(24)
                    is_hot = last[np.minimum(np.searchsorted(last, key), len(last) - 1)] == key
                cold, warm = s[~is_hot][:p], s[is_hot]
                need = p - len(cold)
                lacks = need > 0 and len(s) < n
                short.append(bool(lacks))
                cold_out.append((np.zeros(0, np.int64) if lacks else cold.view(np.int64)))
                hot_out.append((np.zeros(0, np.int64) if lacks or need <= 0 else warm[:need].view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cold_out, pa.list_(pa.int64())), pa.array(hot_out, pa.list_(pa.int64())), pa.array(short, pa.bool_())], names=["row", "cold", "hot", "short"])

    return w.tidy(run)


def bitmap(s: np.ndarray) -> bytes:
    n = max(LEAST_BITS, 1 << max(0, len(s) - 1).bit_length())
    bits = np.zeros(n, np.uint8)
    bits[(s & U(n - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def differing(x: bytes, y: bytes) -> int:
    """How many bits differ; the larger bitmap is folded to the smaller one's bits."""
    a, b = np.frombuffer(x, U), np.frombuffer(y, U)
    if len(a) < len(b):
        a, b = b, a
    if len(a) > len(b):
        a = np.bitwise_or.reduce(a.reshape(-1, len(b)))
    return int(np.bitwise_count(a ^ b).sum(dtype=np.int64))


def _may_link(percent: int, a: np.ndarray, b: np.ndarray, differ: np.ndarray) -> np.ndarray:
    """Whether sets of sizes a and b whose bitmaps differ in so many bits may link."""
    bound = np.minimum((a + b - differ) // 2, np.minimum(a, b))
    return 100 * bound >= percent * (a + b - bound)


def _links(percent: int, x: np.ndarray, y: np.ndarray) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _bound(percent: int):
    """Of a tile's candidates, those that may link by the bound on their overlap. sets: row, n, bitmap."""

    def run(pairs, sets):
        at = {r: k for k, r in enumerate(sets["row"].tolist())}
        n, maps = sets["n"].to_numpy(), sets["bitmap"].to_numpy()
        x, y = (np.fromiter((at[r] for r in pairs[c].tolist()), np.int64, len(pairs)) for c in "xy")
        differ = np.fromiter((differing(maps[i], maps[j]) for i, j in zip(x.tolist(), y.tolist(), strict=True)), np.int64, len(pairs))
        return pairs[_may_link(percent, n[x], n[y], differ)] if len(pairs) else pairs

    return run


def _exact(percent: int):
    """Of a tile's candidates, those that link. sets: row, shingles."""

    def run(pairs, sets):
        own = {r: np.frombuffer(s, U) for r, s in zip(sets["row"].tolist(), sets["shingles"], strict=True)}
        keep = [_links(percent, own[x], own[y]) for x, y in zip(pairs["x"].tolist(), pairs["y"].tolist(), strict=True)]
        return pairs[np.array(keep, bool)][["x", "y"]]

    return run


def bands(percent: int, top: int) -> list[int]:
    """Where bands of sizes begin: linked sets are of one band or of two neighbouring ones."""
    out = [1]
    while out[-1] <= top:
        out.append(out[-1] * 100 // percent + 1)
    return out


def buckets(s: np.ndarray, percent: int, begin: list[int]) -> list[np.ndarray]:
    """Names of buckets of the set, at its own band's level and at that below."""
    n, out = len(s), []
    band = int(np.searchsorted(begin, n, "right")) - 1
    for level in (band, band - 1):
        if level < 0:
            continue
        top = (100 - percent) * (begin[level + 2] + begin[level + 1] - 2) // (100 + percent) if level + 2 < len(begin) else n
        m = top + top // 2 + 2
        partner = n * 100 // percent if level == band else begin[band] - 1
        differ = (100 - percent) * (n + partner) // (100 + percent)
        at = ((w.mix(s ^ U(0xA5A5A5A5)) >> U(32)) * U(m) >> U(32)).astype(np.int64)
        size = np.bincount(at, minlength=m)
        content = np.zeros(m, U)
        np.add.at(content, at, w.mix(s + U(3)))
        name = w.mix(content + np.arange(m, dtype=U) * U(0x9E3779B97F4A7C15) + U(level * 0xD1B54A32D192ED03 & (2**64 - 1)))
        order = np.lexsort((name, -size))[: differ + 1]  # the largest first: in this order too, linked sets share one of the first
        out.append(name[order].view(np.int64))
    return out


def _bucket_rows(percent: int, begin: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [np.concatenate(buckets(np.frombuffer(s, U), percent, begin)) for s in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.list_(pa.int64()))], names=["row", "gids"])

    return w.tidy(run)


class _Join:
    """The state of one join: what is known of the sets, links found, components so far."""

    def __init__(self, scratch: Scratch, light: DataFrame, read, percent: int):
        """light: row, n, bitmap, block. read: rows -> row, shingles of these rows' texts."""
        self.scratch, self.light, self.read, self.percent, self.step, self.fetched = scratch, light, read, percent, 0, 0
        self.edges: DataFrame | None = None
        self.labels: DataFrame | None = None
        self.sets: DataFrame | None = None

    def fetch(self, rows: DataFrame) -> None:
        """Reads the sets of these rows (column row) that aren't there yet."""
        if self.sets is not None:
            rows = rows.join(self.sets.select("row"), "row", "left_anti")
        self.fetched += 1
        rows = self.scratch.save(rows.distinct(), f"wanted{self.fetched}")
        if self.sets is None or not rows.isEmpty():
            new = self.scratch.save(self.read(rows), f"sets{self.fetched}")
            self.sets = new if self.sets is None else self.sets.unionByName(new)

    def found(self, edges: DataFrame) -> None:
        edges = self.scratch.save(edges, f"links{self.step}")
        self.edges = edges if self.edges is None else self.edges.unionByName(edges)
        self.labels = components(self.edges, self.scratch, f"labels{self.step}")

    def tiled(self, pairs: DataFrame, sets: DataFrame, run, schema: str) -> DataFrame:
        """run over each tile's pairs (i, j, x, y) and the sets (row and more) that these need."""
        ends = [pairs.select(F.col("i").alias("ti"), F.col("j").alias("tj"), F.col(c).alias("row")) for c in "xy"]
        held = ends[0].unionByName(ends[1]).distinct().join(sets, "row")
        return pairs.groupBy("i", "j").cogroup(held.groupBy("ti", "tj")).applyInPandas(run, schema)

    def verify(self, pairs: DataFrame) -> None:
        """Adds the links among candidate pairs (x, y) and renews the components."""
        self.step += 1
        x, y = (self.light.select(F.col("row").alias(v), F.col("n").alias(n), F.col("block").alias(b)) for v, n, b in (("x", "a", "p"), ("y", "b", "q")))
        sized = pairs.distinct().join(x, "x").join(y, "y").where(100 * F.least("a", "b") >= self.percent * F.greatest("a", "b"))
        dealt = self.scratch.save(sized.select(F.least("p", "q").alias("i"), F.greatest("p", "q").alias("j"), "x", "y"), f"dealt{self.step}")
        maybe = self.tiled(dealt, self.light.select("row", "n", "bitmap"), _bound(self.percent), "i long, j long, x long, y long")
        maybe = self.scratch.save(maybe, f"maybe{self.step}")
        self.scratch.drop(f"dealt{self.step}")
        self.fetch(maybe.select(F.col("x").alias("row")).unionByName(maybe.select(F.col("y").alias("row"))))
        self.found(self.tiled(maybe, self.sets, _exact(self.percent), "x long, y long"))
        self.scratch.drop(f"maybe{self.step}")

    def open(self, groups: DataFrame, name: str) -> DataFrame:
        """The members (gid, c, row, label) of groups that are of several components."""
        lab = groups.join(self.labels, groups.row == self.labels.v, "left").select("gid", "c", "row", F.coalesce("label", "row").alias("label"))
        lab = self.scratch.save(lab, f"{name}-labelled")
        mixed = self.scratch.save(lab.groupBy("gid").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("gid"), f"{name}-mixed")
        return self.scratch.save(lab.join(mixed, "gid"), name)

    def resolve(self, groups: DataFrame, many: int) -> None:
        """groups: gid, c (members), row, pivot (the first of them). Finds links enough to join all that are linked."""
        self.verify(groups.where("row <> pivot").select(F.col("row").alias("x"), F.col("pivot").alias("y")))
        left = self.open(groups.where("c > 2"), "open")
        few = left.where(F.col("c") <= many)
        x, y = (few.select("gid", F.col("row").alias(v), F.col("label").alias(m)) for v, m in (("x", "k"), ("y", "l")))
        pairs = x.join(y, "gid").where("x < y and k <> l").select("x", "y")
        if not few.isEmpty():
            self.verify(pairs)
            left = self.open(left.where(F.col("c") > many).drop("label"), "still-open")
        left = left.where(F.col("c") > many)
        if not left.isEmpty():
            self.tiles(left.select("row", "label").distinct())

    def tiles(self, rows: DataFrame) -> None:
        """Adds links between rows of different labels (row, label), enough to join all that are linked."""
        self.step += 1
        self.fetch(rows.select("row"))
        r = blocks(self.scratch, rows.join(self.light.drop("block"), "row"), f"tile-rows{self.step}")
        # blocks meet if their sizes may link: then they touch one band of sizes, or two that are neighbours
        band = lambda c: F.floor(F.log(F.col(c).cast("double")) / F.lit(np.log(100 / self.percent))).cast("long")
        meta = self.scratch.save(r.groupBy("block").agg(F.min("n").alias("lo"), F.max("n").alias("hi")), f"tile-blocks{self.step}")
        a = meta.select(F.col("block").alias("i"), F.col("hi").alias("top"), F.explode(F.sequence(band("lo"), band("hi") + 2)).alias("band"))
        b = meta.select(F.col("block").alias("j"), F.col("lo").alias("low"), F.explode(F.sequence(band("lo"), band("hi"))).alias("band"))
        tile = a.join(b, "band").where((F.col("i") <= F.col("j")) & (100 * F.col("top") >= self.percent * F.col("low"))).select("i", "j").distinct()
        uses = self.scratch.save(tile.select("i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block")), f"tile-uses{self.step}")
        held = r.join(self.sets, "row").select("row", "label", "n", "bitmap", "shingles", "block")
        self.found(held.join(uses, "block").groupBy("i", "j").applyInPandas(_tile(self.percent), "x long, y long"))


def blocks(scratch: Scratch, rows: DataFrame, name: str) -> DataFrame:
    """rows (row, n and more) with a block: sorted by n and cut where TILE_BYTES of sets are together."""
    from pyspark.sql import Window as W

    r = rows.withColumn("_w", F.greatest(F.lit(2048), F.col("n") * 8))
    by_size = r.groupBy("n").agg(F.sum("_w").alias("total"))
    # one row for each size; rows of a size are spread over its stretch of bytes
    at = by_size.withColumn("at", F.sum("total").over(W.orderBy("n")) - F.col("total"))
    at = scratch.save(at, f"{name}-sizes")
    out = r.join(at, "n").withColumn("block", F.floor((F.col("at") + F.pmod(F.xxhash64("row"), F.col("total"))) / TILE_BYTES))
    return scratch.save(out.drop("_w", "total", "at"), name)


def _tile(percent: int):
    """Links between two blocks of sets (or inside of one) of different labels; none between what is already joined."""

    def run(key, rows):
        import pandas as pd

        least = min(map(len, rows["bitmap"]))
        fold = lambda m: np.bitwise_or.reduce(np.frombuffer(m, U).reshape(-1, least // 8))
        rows = rows.sort_values("row").drop_duplicates("row").reset_index(drop=True)
        maps, n, block = np.stack([fold(m) for m in rows["bitmap"]]), rows["n"].to_numpy(), rows["block"].to_numpy()
        label, ids = rows["label"].to_numpy(), rows["row"].to_numpy()
        sets = [np.frombuffer(s, U) for s in rows["shingles"]]
        root = {x: x for x in label.tolist()}

        def find(x):
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        left = np.flatnonzero(block == key[0])
        right = np.flatnonzero(block == key[1])
        out = []
        for a in left.tolist():
            other = right[right > a] if key[0] == key[1] else right
            differ = np.bitwise_count(maps[other] ^ maps[a]).sum(1, dtype=np.int64)
            for b in other[_may_link(percent, n[other], n[a], differ) & (label[other] != label[a])].tolist():
                x, y = find(int(label[a])), find(int(label[b]))
                if x != y and _links(percent, sets[a], sets[b]):
                    root[max(x, y)] = min(x, y)
                    out.append((int(ids[a]), int(ids[b])))
        return pd.DataFrame(out, columns=["x", "y"])

    return run


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", many: int = MANY) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id (the smallest id that can be reached by links).

    A-Z are lower-cased, words are [^\\x20\\x09-\\x0D]+. A null or wordless text has no
    shingles, no links and its own id as component; a null id is never smallest unless
    all of its component are null. Repeated rows have equal sets and so one component.
    An empty table gives an empty result. Texts are read whole. Other columns are not
    read, whatever their names."""
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark, "jaccard")
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()
    sets = src.mapInArrow(_sets(words, percent), f"doc_id {kind}, n long, s1 long, s2 long, first binary, bitmap binary")
    sets = scratch.save(sets.withColumn("row", F.monotonically_increasing_id()), "sets")

    digest = ["s1", "s2", "n"]
    reps = scratch.save(sets.where("n > 0").groupBy(*digest).agg(F.min("row").alias("rep"), F.count("*").alias("c")).where("c > 1").drop("c"), "reps")
    members = scratch.save(sets.select("row", "doc_id", *digest).join(reps, digest, "left").select("row", "doc_id", "n", "s1", "s2", F.coalesce("rep", "row").alias("rep")), "members")
    copies = members.where("row <> rep").select("row")
    own = sets.where("n > 0").join(copies, "row", "left_anti").select("row", "n", "first")

    def read(rows: DataFrame) -> DataFrame:
        """The whole sets of rows: their texts' ids pass a sieve, and a join by id and digest decides."""
        wanted = rows.join(members, "row").select("row", F.col("doc_id").alias("id"), "s1", "s2")
        sieve = Sieve(wanted.select(F.xxhash64("id").alias("key")), wanted.count())
        full = src.withColumn("key", F.xxhash64("doc_id")).mapInArrow(_whole(words, sieve), f"_id {kind}, s1 long, s2 long, shingles binary").alias("f")
        same = (F.col("f.s1") == F.col("r.s1")) & (F.col("f.s2") == F.col("r.s2")) & F.col("_id").eqNullSafe(F.col("id"))
        return full.join(wanted.alias("r"), same).select("row", "shingles")

    # shingles of many sets: counted by ranges of their hashes
    volume = own.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    shards = int(max(16, volume >> 20))
    counted = own.select("first").mapInArrow(_count(shards), "shard long, tokens binary, counts binary")
    frequent = scratch.save(counted.groupBy("shard").applyInPandas(_hot(many), "level long, n long, tokens binary"), "frequent")
    level, held = None, 0  # the most frequent, as many as MOST_HOT allows
    for r in sorted(frequent.groupBy("level").agg(F.sum("n").alias("n")).collect(), reverse=True):
        if held + r["n"] > MOST_HOT:
            break
        level, held = r["level"], held + r["n"]
    hot = frequent.where(F.lit(False) if level is None else F.col("level") >= level).select("tokens")
    hot = spark.sparkContext.broadcast(np.sort(np.frombuffer(b"".join(r[0] for r in hot.collect()), U)).tobytes())
    out_schema = "row long, cold array<long>, hot array<long>, short boolean"
    lead = scratch.save(own.mapInArrow(_prefixes(percent, hot, False), out_schema), "lead")
    short = lead.where("short").select("row")
    if not short.isEmpty():  # sets whose stored part doesn't reach far enough are read again, whole
        again = read(short).join(members.select("row", "n"), "row").select("row", "n", F.col("shingles").alias("first")).dropDuplicates(["row"])
        lead = scratch.save(lead.where("not short").unionByName(again.mapInArrow(_prefixes(percent, hot, True), out_schema)), "lead2")
        scratch.drop("lead")
    scratch.drop("frequent")

    def grouped(rows: DataFrame, name: str) -> DataFrame:
        """Members (gid, row) of groups of two or more, with their number c and the first of them."""
        shared = scratch.save(rows.groupBy("gid").agg(F.count("*").alias("c"), F.min("row").alias("pivot")).where("c > 1"), f"{name}-shared")
        out = scratch.save(rows.join(shared, "gid").select("gid", "c", "row", "pivot"), name)
        scratch.drop(f"{name}-shared")
        return out

    cold = grouped(lead.select(F.explode("cold").alias("gid"), "row"), "groups")
    # shingles beyond the stored parts weren't counted before: their groups may be as large as those of hot ones
    warm = scratch.save(lead.where("size(hot) > 0").select("row").unionByName(cold.where(F.col("c") > many).select("row")).distinct(), "warm")
    scratch.drop("lead", "lead2")
    cold = cold.where(F.col("c") <= many)

    light = sets.select("row", "n", "bitmap").join(cold.select("row").unionByName(warm).distinct(), "row")
    light = blocks(scratch, light, "light")
    scratch.drop("sets", "reps")
    join = _Join(scratch, light, read, percent)
    groups = cold
    if not warm.isEmpty():
        join.fetch(warm)
        top = light.agg(F.coalesce(F.max("n"), F.lit(1))).first()[0]
        begin = bands(percent, top) + [0, 0]
        begin[-2] = begin[-3] * 100 // percent + 1
        begin[-1] = begin[-2] * 100 // percent + 1
        parts = join.sets.mapInArrow(_bucket_rows(percent, begin), "row long, gids array<long>").select(F.explode("gids").alias("gid"), "row")
        groups = cold.unionByName(grouped(scratch.save(parts, "buckets"), "bucket-groups"))
        scratch.drop("buckets")
    join.resolve(groups, many)
    labels = join.labels
    named = members.join(labels, members.rep == labels.v, "left").withColumn("label", F.coalesce("label", "rep"))
    named = scratch.save(named.select("doc_id", "n", "label"), "named")
    least = named.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    least = scratch.save(least, "least")
    hot.destroy()
    for name in [p for p in scratch.names if p not in ("named", "least")]:
        scratch.drop(name)
    return named.join(least, "label").select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of docs, all columns, of which one of each component stays: that with the smallest id, null last.

    Rows that share an id are told apart by their texts, the first by its digest being
    the smaller; rows that repeat id and text are reduced to one. Wordless texts are
    linked with nothing and all stay, but for such repeats."""
    key, other = names(docs, "key", "other")
    made = F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("sha"))
    own = docs.select(made.alias("doc_id"), F.col(text_col).alias("text"))
    found = near_duplicates(own, **how)
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias(other)).distinct()
    keyed = docs.withColumn(key, made)
    left = keyed.join(gone, F.col(key) == F.col(other), "left_anti")
    if not found.groupBy("doc_id").count().where("count > 1").isEmpty():
        left = left.dropDuplicates([key])
    return left.select(*docs.columns)


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=3, percent=90)


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN [array_to_string(w[i:i + 2], ' ') FOR i IN range(1, len(w) - 1)]
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), e AS (
  SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 90 * (nx.n + ny.n - c)
), r(v, u) AS (
  SELECT doc_id, doc_id FROM d UNION SELECT r.v, e.y FROM r JOIN e ON e.x = r.u
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, (SELECT min(u) FROM r WHERE v = d.doc_id) AS component_id
FROM d LEFT JOIN n USING (doc_id)
"""
