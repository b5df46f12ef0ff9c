"""Exact deduplication by deterministic block naming, in DataFrame operations only.

The normalised text is cut into blocks of a fixed number of bytes. Equal blocks get
one integer name by sorting the distinct blocks; then adjacent pairs of names are
named in the same way, level by level, until every document has one name. Two
documents have the same (level, name) if and only if their texts are equal: unequal
blocks never share a name, and a last odd name is paired with -1, so that texts of
unequal length differ too.

Block contents are shuffled once, to be sorted, after the distinct on the map side.
Occurrences find their names by a 64-bit key of the block; blocks that share a key
(none in practice) are told apart by their contents in a join of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkronym.llm.common import SPACE, Scratch, names

BLOCK_BYTES = 4096


def normalised(text: str | Column) -> Column:
    """The text with each run of white space as one space; null counts as empty."""
    c = F.col(text) if isinstance(text, str) else text
    return F.regexp_replace(F.coalesce(c, F.lit("")), SPACE, " ")


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, key_bits: int = 63
) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal normalised texts the row with the smallest id stays. Nulls: a null text
    is the empty text; a null id is larger than all others (keep_id is null only if
    all ids of the group are). Repeated rows each count and are each returned; of rows
    with the smallest id one is kept. Empty and blank texts are texts like others. An
    empty table gives an empty result. Other columns are not read.
    key_bits: of the key by which occurrences find their blocks' names; small values
    only serve to test the treatment of blocks that share a key."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "exact-dedup")
    norm = docs.select(F.col(id_col).alias("id"), normalised(text_col).alias("t"))
    # the digest is an output column; with the id it tells rows apart while they are in pieces
    raw = norm.select("id", F.unhex(F.sha2("t", 256)).alias("sha"), F.col("t").cast("binary").alias("t"))
    last = F.greatest(F.lit(0), F.ceil(F.length("t") / F.lit(block_bytes)).cast("int") - 1)
    cut = F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(F.col("t"), i * block_bytes + 1, F.lit(block_bytes)))
    blocks = raw.select("id", "sha", F.posexplode(cut).alias("pos", "block"))
    keyed = blocks.withColumn("h", F.xxhash64("block").bitwiseAND(F.lit((1 << key_bits) - 1)))

    named = (
        keyed.groupBy("h").agg(F.collect_set("block").alias("set"))
        .select("h", F.size("set").alias("n"), F.explode("set").alias("block"))
        .sortWithinPartitions("block")
        .select("h", F.monotonically_increasing_id().alias("name"), F.when(F.col("n") > 1, F.col("block")).alias("clash"))
    )
    named = scratch.save(named, "names")
    clash = named.where("clash is not null")
    occurrences = keyed.select("id", "sha", "pos", "h")
    if clash.isEmpty():
        seq = occurrences.join(named.select("h", "name"), "h").select("id", "sha", "pos", "name")
    else:
        rest = occurrences.join(clash.select("h").distinct(), "h", "left_anti").join(named.select("h", "name"), "h")
        own = keyed.join(clash, "h").where("block = clash")
        seq = rest.select("id", "sha", "pos", "name").unionByName(own.select("id", "sha", "pos", "name"))
    seq = scratch.save(seq, "level0")
    scratch.drop("names")

    # rows that repeat as a whole have been pieces of one; their number comes back at the end
    done, level = [], 0
    many = scalar_max(seq, "pos")
    while True:
        one = seq.where("pos = 0")
        if many == 0:
            done.append(one.select("id", "sha", F.lit(level).alias("level"), "name"))
            break
        more = seq.groupBy("id", "sha", F.shiftright("pos", 1).alias("pos")).agg(
            F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("l"),
            F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("r"),
        )
        # whoever has a single name is done: its pair at position 0 has no right side
        done.append(
            more.where("pos = 0 and r = -1").select("id", "sha", F.lit(level).alias("level"), F.col("l").alias("name"))
        )
        more = more.where("not (pos = 0 and r = -1)")
        level, many = level + 1, many // 2
        pairs = more.groupBy("l", "r").agg(F.lit(1).alias("x")).sortWithinPartitions("l", "r").select("l", "r", F.monotonically_increasing_id().alias("name"))
        pairs = scratch.save(pairs, f"pairs{level}")  # written, so that the join deals both sides anew and a pair of many copies can be split
        seq = scratch.save(more.join(pairs, ["l", "r"]).select("id", "sha", "pos", "name"), f"level{level}")
        scratch.drop(f"pairs{level}")
    found = done[0]
    for d in done[1:]:
        found = found.unionByName(d)
    found = found.dropDuplicates(["id", "sha"])

    counts = raw.groupBy("id", "sha").agg(F.count("*").alias("n"))
    rows = scratch.save(found.join(counts, (found.id.eqNullSafe(counts.id)) & (found.sha == counts.sha)).select(found.id, found.sha, "level", "name", "n"), "rows")
    scratch.drop(*(f"level{i}" for i in range(level + 1)))
    groups = scratch.save(rows.groupBy("level", "name").agg(F.min("id").alias("keep_id"), F.sum("n").alias("group_size")), "groups")
    return (
        rows.join(groups, ["level", "name"])
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n"))))
        .select(
            F.col("id").alias("doc_id"), "keep_id", "group_size",
            (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
            F.lower(F.hex("sha")).alias("text_sha256"),
        )
    )


def scalar_max(df: DataFrame, c: str) -> int:
    return df.agg(F.coalesce(F.max(c), F.lit(0))).first()[0]


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of docs, all columns, of which each text stays once: that with the smallest id.

    Rows that share an id are told apart by their texts; rows that repeat id and text are
    reduced to one. Nulls, empty texts and an empty table are as in exact_groups; other
    columns stay as they are, whatever their names. What is dropped is the smaller side
    of an anti join, which Spark broadcasts or sorts by its size."""
    found = exact_groups(docs, id_col, text_col, **how)
    rows = found.groupBy("doc_id", "text_sha256").agg(F.max("kept").alias("k"), F.count("*").alias("n"))
    own, sha = names(docs, "id", "sha")
    gone = rows.where("not k").select(F.col("doc_id").alias(own), F.col("text_sha256").alias(sha))
    left = docs.join(gone, docs[id_col].eqNullSafe(gone[own]) & (F.sha2(normalised(docs[text_col]), 256) == gone[sha]), "left_anti")
    if not rows.where("n > 1").isEmpty():
        left = left.withColumn(sha, F.sha2(normalised(text_col), 256)).dropDuplicates([id_col, sha]).drop(sha)
    return left


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH t AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
), g AS (
  SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm
)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.norm) AS text_sha256
FROM t JOIN g USING (norm)
"""
