"""Line dedup by a log-template tree.

A line's tokens with a digit are variable fields. The tree's path to a leaf is of fixed
depth: the number of tokens, then the first DEPTH of them. In a leaf, a token is constant
if lines of min_docs documents have it at its place (a line counts for two documents at
most), and the others are variable: a line whose constant tokens are SIMILAR of all or
more has them, and `<*>` for the rest, as its template; another line is its own. So a
template depends on which lines a leaf has, not on their order or on how they are dealt
to tasks. A template that occurs in min_docs documents or more is recurring: its lines
are dropped, but for those of the document with the smallest id. A line that stands in
two documents alike, up to its variable fields, is dropped from the second on, whatever
its template.

Lines go through the plan as 128 bits, without their texts. Only leaves of two or more
different lines and documents need a template; the texts of their lines are read again,
past a sieve, as one row for each different line, and then a row for each of its tokens.
Constant tokens are sums by (leaf, place, token), so that a leaf of any size is spread
over all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkronym.llm import words as w
from sparkronym.llm.common import Scratch, ship
from sparkronym.llm.sieve import Sieve

DEPTH, SIMILAR, MIN_DOCS = 3, 0.7, 3
VARIABLE = "<*>"
U = np.uint64


def _constant(k: int) -> np.uint64:
    return U(k * 0x9E3779B97F4A7C15 & (2**64 - 1))


class _Lines:
    """The lines with words of a slice of texts: document, place in it, leaf and 128 bits of the masked line."""

    def __init__(self, column: pa.Array):
        data, off = w.text_bytes(column)
        starts, ends, of = w.spans(data, off)
        doc = np.repeat(np.arange(len(off) - 1), np.diff(of))
        feeds = np.concatenate(([0], np.cumsum(data == 0x0A)))
        line = feeds[starts] + doc
        digits = np.concatenate(([0], np.cumsum((data >= 0x30) & (data <= 0x39))))
        token = w.hashes(data, starts, ends, 2)
        self.masked = digits[ends] > digits[starts]
        variable = np.frombuffer(VARIABLE.encode(), np.uint8)
        token[self.masked] = w.hashes(variable, np.array([0]), np.array([len(variable)]), 2)[0]
        new = np.ones(len(line), bool)
        new[1:] = line[1:] != line[:-1]
        self.data, self.starts, self.ends = data, starts, ends
        self.first = np.flatnonzero(new)
        self.size = np.diff(np.append(self.first, len(line)))
        self.doc = doc[self.first]
        self.pos = line[self.first] - (feeds[off[:-1]] + np.arange(len(off) - 1))[self.doc]
        leaf = w.mix(self.size.astype(U) * _constant(1))
        for k in range(DEPTH):
            has = self.size > k
            leaf[has] = w.mix(leaf[has] * _constant(3) ^ token[self.first[has] + k])
        self.leaf = leaf.view(np.int64)
        place = np.arange(len(token)) - np.repeat(self.first, self.size)
        self.bits = []
        for seed in (5, 7):
            each = w.mix(token ^ w.mix(place.astype(U) * _constant(seed) + _constant(seed + 1)))
            total = np.add.reduceat(each, self.first) if len(each) else each
            self.bits.append(w.mix(total + self.size.astype(U)).view(np.int64))

    def text(self, k: int) -> str:
        a, n = self.first[k], self.size[k]
        tokens = [VARIABLE if m else self.data[s:e].tobytes().decode() for s, e, m in zip(self.starts[a : a + n], self.ends[a : a + n], self.masked[a : a + n], strict=True)]
        return " ".join(tokens)


def _light(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each line with words."""
    for batch in batches:
        for part in w.slices(batch, 2):
            x = _Lines(part.column(2))
            at = pa.array(x.doc)
            yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at), pa.array(x.pos, pa.int32()), pa.array(x.leaf), *map(pa.array, x.bits)], names=["doc_id", "of", "pos", "leaf", "a", "b"])


def _texts(sieve: Sieve):
    """The masked lines whose leaf passes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in w.slices(batch, 0):
                x = _Lines(part.column(0))
                at = np.flatnonzero(sieve.passes(x.leaf))
                _, one = np.unique(np.stack([b[at] for b in x.bits], 1), axis=0, return_index=True)
                at = at[one]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x.leaf[at]), *(pa.array(b[at]) for b in x.bits), pa.array([x.text(k) for k in at.tolist()], pa.string())],
                    names=["leaf", "a", "b", "masked"],
                )

    return w.tidy(run)


def templates(scratch: Scratch, lines: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """a, b and 128 bits (t, u) of the template of different lines (a, b, leaf, masked, docs: for how many documents a
    line counts) that have enough constant tokens. Every leaf's lines count for min_docs documents or more.

    Leading tokens are the leaf's and so constant. A template is the set of its other constant tokens with their
    places, `<*>` apart: its bits are those of each of them, folded by exclusive or."""
    words = F.split("masked", " ")
    rest = F.posexplode(F.slice(words, DEPTH + 1, F.greatest(F.size(words) - DEPTH, F.lit(0))))
    tokens = scratch.save(lines.select("a", "b", "leaf", "docs", F.size(words).alias("n"), rest.alias("place", "token")), "tokens")
    held = tokens.groupBy("leaf", "place", "token").agg(F.sum("docs").alias("k")).where(F.col("k") >= min_docs).select("leaf", "place", "token")
    each = tokens.join(scratch.save(held, "constants"), ["leaf", "place", "token"])  # a token of many lines is split by Spark
    bits = lambda k: F.when(F.col("token") != VARIABLE, F.xxhash64(F.lit(k), "place", "token"))
    each = each.select("a", "b", "leaf", "n", F.lit(1).alias("c"), bits(1).alias("t"), bits(2).alias("u"))
    none = lines.select("a", "b", "leaf", F.size(words).alias("n"), F.lit(0).alias("c"), F.lit(0).cast("long").alias("t"), F.lit(0).cast("long").alias("u"))
    of = each.unionByName(none).groupBy("a", "b", "leaf", "n").agg(F.sum("c").alias("c"), F.bit_xor("t").alias("t"), F.bit_xor("u").alias("u"))
    return of.where(F.col("c") + DEPTH >= F.lit(SIMILAR) * F.col("n")).select("a", "b", F.xxhash64("leaf", "t").alias("t"), F.xxhash64("u", "leaf").alias("u"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, text, places of lines that go) as id, number of lines, of those gone, and the others' text."""
    for batch in batches:
        for part in w.slices(batch, 1):
            n, k, kept = [], [], []
            for text, gone in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                lines = [] if text is None else text.split("\n")
                drop = set(gone or ())
                n.append(len(lines))
                k.append(len(drop))
                kept.append("\n".join([x for i, x in enumerate(lines) if i not in drop]) if drop else text or "")
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(k, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_lines", "n_dropped", "kept_text"])


def drop_lines(docs: DataFrame, min_docs: int = MIN_DOCS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_lines, n_dropped, kept_text (kept lines joined by line feeds).

    A null text has no lines and an empty kept text; an empty text has one line. Blank
    lines are of no template and stay. Rows that share an id count as one document, with
    all their lines; repeated rows lose the same lines. Rows of no id count as one
    document, larger than all others. Among documents with a line alike the smallest id
    keeps it. An
    empty table gives an empty result. Other columns are not read, whatever their names.
    Texts and lines are read whole, whatever their length."""
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark, "lines")
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()
    keyed = src.select("doc_id", F.xxhash64("text").alias("of"), "text")  # of: tells texts of one id apart
    lines = scratch.save(keyed.mapInArrow(w.tidy(_light), f"doc_id {kind}, of long, pos int, leaf long, a long, b long"), "lines")

    several = "lo <> hi or (none and lo is not null)"
    docs_of = [F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.max(F.col("doc_id").isNull()).alias("none")]
    different = scratch.save(lines.groupBy("a", "b").agg(F.min("leaf").alias("leaf"), *docs_of), "different")
    docs = F.when(F.expr(several), 2).otherwise(1)
    leaves = different.groupBy("leaf").agg(F.count("*").alias("n"), F.sum(docs).alias("docs"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("none").alias("none")).where((F.col("n") > 1) & (F.col("docs") >= min_docs)).where(several)
    leaves = scratch.save(leaves.select("leaf", "n"), "leaves")

    sieve = Sieve(leaves.select("leaf"), leaves.count())
    texts = src.select("text").mapInArrow(_texts(sieve), "leaf long, a long, b long, masked string").join(leaves.select("leaf"), "leaf", "left_semi")
    texts = scratch.save(texts.dropDuplicates(["a", "b"]), "texts")
    of = templates(scratch, texts.join(different.select("a", "b", docs.alias("docs")), ["a", "b"]), min_docs)
    of = scratch.save(of, "of")
    held = lines.select("a", "b", "doc_id").join(of, ["a", "b"]).select("t", "u", "doc_id").distinct()
    recurring = scratch.save(held.groupBy("t", "u").agg(F.count("*").alias("docs"), F.min("doc_id").alias("first")).where(F.col("docs") >= min_docs).select("t", "u", "first"), "recurring")
    none = F.lit(None).cast(kind)
    goes = different.where(several).select("a", "b", F.col("lo").alias("own"), none.alias("first")).unionByName(of.join(recurring, ["t", "u"]).select("a", "b", none.alias("own"), "first"))
    goes = scratch.save(goes.groupBy("a", "b").agg(F.max("own").alias("own"), F.max("first").alias("first")), "goes")
    other = lambda c: F.col(c).isNotNull() & ~F.col("doc_id").eqNullSafe(F.col(c))
    gone = lines.join(goes, ["a", "b"]).where(other("own") | other("first")).groupBy("doc_id", "of").agg(F.collect_set("pos").alias("gone"))
    gone = scratch.save(gone.select(F.col("doc_id").alias("id"), F.col("of").alias("text_of"), "gone"), "gone")
    scratch.drop(*(x for x in scratch.names if x != "gone"))
    both = keyed.join(gone, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("of") == F.col("text_of")), "left").select("doc_id", "text", "gone")
    return both.mapInArrow(w.tidy(_cut), f"doc_id {kind}, n_lines long, n_dropped long, kept_text string")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))
