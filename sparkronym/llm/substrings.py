"""Removal of passages that repeat across documents, found by a count-min prefilter.

A window is a number of consecutive words of one document. A word goes if a window that
covers it has a sequence of words that also starts in a document with a smaller id.

First pass: each window is stood for by its anchor, the run of RUN words inside it with
the smallest hash. Equal windows have equal anchors, so that the number of documents
with a window is at most that of documents with its anchor, which a count-min sketch
estimates from above. Each partition makes its own sketch; they are merged cell by cell,
and of the sum only whether it reaches two is kept: one bit a cell. Second pass: windows
whose anchor is estimated in two documents or more are grouped exactly, by 128 bits of
their words, and no other; none that repeats is lost. Of marked documents with the same
words from end to end, by their digest, one goes on to be grouped, as the windows of the
others are its own.

The sketch has CELLS cells for each anchor and MOST_BITS at most, which is what is
broadcast, whatever the input's size: beyond some 130 million anchors it overestimates
more of them, so that more windows are grouped; none that repeats is ever lost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkronym.llm import words as w
from sparkronym.llm.common import Scratch, ship

WINDOW = 50
RUN = 13
#: Rows of the sketch, its cells in each row for an anchor, and bits of it at most (64 MB).
ROWS, CELLS, MOST_BITS = 2, 4, 1 << 29
SLAB = 20
U = np.uint64


def anchors(word: np.ndarray, k: int) -> np.ndarray:
    """For each k consecutive words, the smallest hash of RUN (or k, if less) words among them."""
    q = min(RUN, k)
    x, span, got = w.runs(word, q, 3), k - q + 1, 1
    while got < span:  # minima over got values, then over twice as many
        step = min(got, span - got)
        x = np.minimum(x[: len(x) - step], x[step:])
        got += step
    return x


def cells(anchor: np.ndarray, row: int, bits: int) -> np.ndarray:
    return w.mix(anchor + U((row + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))) >> U(64 - bits)


class _Words:
    """The words of a slice of texts, and which starts are of windows inside one text."""

    def __init__(self, column: pa.Array, k: int):
        self.data, off = w.text_bytes(column)
        self.off = off
        starts, ends, self.of = w.spans(self.data, off)
        self.hash = w.hashes(self.data, starts, ends)
        self.starts, self.ends, n = starts, ends, len(starts)
        doc = np.repeat(np.arange(len(off) - 1), np.diff(self.of))
        ok = np.arange(max(0, n - k + 1))
        self.windows = ok[self.of[1:][doc[: len(ok)]] - ok >= k]
        self.doc = doc

    def anchors(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each window: its text and its anchor."""
        if not len(self.windows):
            return self.windows, np.zeros(0, U)
        return self.doc[self.windows], anchors(self.hash, k)[self.windows]


def _gather(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in w.slices(batch, "text"):
                doc, a = _Words(part.column(0), k).anchors(k)
                new = np.ones(len(a), bool)
                new[1:] = (a[1:] != a[:-1]) | (doc[1:] != doc[:-1])
                doc, a = doc[new], a[new]
                order = np.lexsort((a, doc))
                doc, a = doc[order], a[order]
                new = np.ones(len(a), bool)
                new[1:] = (a[1:] != a[:-1]) | (doc[1:] != doc[:-1])
                a = a[new]
                yield pa.RecordBatch.from_arrays([pa.array([len(a)], pa.int64()), pa.array([a.tobytes()], pa.binary())], names=["n", "anchors"])

    return w.tidy(run)


def _sketch(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a = np.frombuffer(b"".join(batch.column(0).to_pylist()), U)
            out = {"slab": [], "cells": [], "counts": []}
            for row in range(ROWS):
                cell, n = np.unique(cells(a, row, bits), return_counts=True)
                slab = (cell >> U(SLAB)).astype(np.int64)
                cuts = np.flatnonzero(np.diff(slab)) + 1
                for s, c, m in zip(np.split(slab, cuts), np.split(cell, cuts), np.split(n, cuts), strict=True):
                    if len(s):
                        out["slab"].append(int(s[0]) + (row << 32))
                        out["cells"].append((c & U((1 << SLAB) - 1)).astype(np.uint32).tobytes())
                        out["counts"].append(np.minimum(m, 2).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out["slab"], pa.int64()), pa.array(out["cells"], pa.binary()), pa.array(out["counts"], pa.binary())], names=["slab", "cells", "counts"])

    return w.tidy(run)


def _merge(key, rows):
    import pandas as pd

    count = np.zeros(1 << SLAB, np.uint8)
    for c, n in zip(rows["cells"], rows["counts"], strict=True):
        at = np.frombuffer(c, np.uint32)
        count[at] = np.minimum(count[at] + np.frombuffer(n, np.uint8), 2)
    return pd.DataFrame({"slab": [key[0]], "bits": [np.packbits(count >= 2, bitorder="little").tobytes()]})


def _build(spark: SparkSession, stored: DataFrame, bits: int):
    merged = (
        stored.select("anchors").mapInArrow(_sketch(bits), "slab long, cells binary, counts binary")
        .groupBy("slab").applyInPandas(_merge, "slab long, bits binary")
    )
    size = max(1 << SLAB, 1 << bits) // 8
    rows = [bytearray(size) for _ in range(ROWS)]
    for slab, b in merged.collect():  # as many bits as are broadcast
        at = (slab & 0xFFFFFFFF) * ((1 << SLAB) // 8)
        rows[slab >> 32][at : at + len(b)] = b
    return spark.sparkContext.broadcast([bytes(r) for r in rows])


def _asked(sketch: list[bytes], bits: int, a: np.ndarray) -> np.ndarray:
    """Whether each anchor is estimated in two documents or more."""
    ok = np.ones(len(a), bool)
    for row, b in enumerate(sketch):
        c = cells(a, row, bits)
        ok &= (np.frombuffer(b, np.uint8)[(c >> U(3)).astype(np.int64)] >> (c & U(7)).astype(np.uint8)) & 1 == 1
    return ok


def _mark(k: int, sketch, bits: int, every: bool):
    """Per row its words, the digest of all of them and, where a window may repeat, the text and those windows as runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = sketch.value
        for batch in batches:
            for part in w.slices(batch, "text"):
                x = _Words(part.column(1), k)
                doc, a = x.anchors(k)
                # asked once for each stretch of windows with one anchor
                new = np.ones(len(a), bool)
                new[1:] = a[1:] != a[:-1]
                group = np.cumsum(new) - 1
                once = a[new]
                hit = _asked(use, bits, once)
                hit = hit[group] if len(a) else np.zeros(0, bool)
                at, doc = x.windows[hit] - x.of[doc[hit]], doc[hit]
                first = np.ones(len(at), bool)
                first[1:] = (at[1:] != at[:-1] + 1) | (doc[1:] != doc[:-1])
                lo = np.flatnonzero(first)
                hi = np.append(lo[1:], len(at)) - 1 if len(at) else lo
                owner = doc[lo]
                begin, end = at[lo], at[hi] + 1
                bound = np.searchsorted(owner, np.arange(len(part) + 1))
                raw = x.data.tobytes()
                texts = [raw[s:e] for s, e in zip(x.off[:-1].tolist(), x.off[1:].tolist(), strict=True)]
                has = np.diff(bound) > 0
                runs = np.stack((begin, end), 1).ravel().astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array(np.diff(x.of), pa.int64()),
                        pa.array([hashlib.sha256(b" ".join(t.split())).hexdigest() for t in texts]),
                        pa.array([t if m or every else None for t, m in zip(texts, has.tolist(), strict=True)], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(bound * 2, pa.int32()), pa.array(runs, pa.int64())),
                    ],
                    names=["doc_id", "n_words", "sha", "text", "runs"],
                )

    return w.tidy(run)


def _windows(k: int):
    """A row for each marked window: 128 bits of its words, its document, row and place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in w.slices(batch, "text", 1 << 20):
                x = _Words(part.column(2).cast(pa.string()), k)
                second = w.hashes(x.data, x.starts, x.ends, 1)
                runs = part.column(3).flatten().to_numpy(zero_copy_only=False).reshape(-1, 2)
                per = np.diff(part.column(3).offsets.to_numpy()) // 2
                owner = np.repeat(np.arange(len(part)), per)
                n = runs[:, 1] - runs[:, 0]
                doc = np.repeat(owner, n)
                at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(runs[:, 0], n)
                start = at + x.of[doc]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(w.runs(x.hash, k)[start].view(np.int64)),
                        pa.array(w.runs(second, k, 1)[start].view(np.int64)),
                        part.column(0).take(pa.array(doc)),
                        part.column(1).take(pa.array(doc)),
                        pa.array(at, pa.int32()),
                    ],
                    names=["a", "b", "doc_id", "row", "at"],
                )

    return w.tidy(run)


def _cut(k: int):
    """The words of each text that no removed window covers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_removed, kept = [], []
            for text, at in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                all_words = text.split()
                cover = np.zeros(len(all_words) + 1, np.int64)
                at = np.array(at, np.int64)
                np.add.at(cover, at, 1)
                np.add.at(cover, at + k, -1)
                gone = np.cumsum(cover)[:-1] > 0
                n_removed.append(int(gone.sum()))
                kept.append(b" ".join([x for x, g in zip(all_words, gone.tolist(), strict=True) if not g]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_removed, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in kept]), pa.array(kept, pa.binary()).cast(pa.string())],
                names=["row", "n_removed", "kept_sha256", "kept_text"],
            )

    return w.tidy(run)


def remove_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, most_bits: int = MOST_BITS) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, kept_sha256 (and kept_text).

    Windows are judged on the input, not on what is left. A null text has no words; a
    text of fewer words than a window stays whole (kept words joined by one space). A
    null id is larger than all others. Rows that repeat an id are not each other's
    source, as neither id is smaller. An empty table gives an empty result. Other
    columns are not read. Texts are read whole, whatever their length."""
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark, "substrings")
    texts = docs.select(F.col(text_col).alias("text"))
    stored = scratch.save(texts.mapInArrow(_gather(window), "n long, anchors binary"), "anchors", "uncompressed")
    total = stored.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # the largest power of two within the bound, or the least that has CELLS for each anchor
    bits = max(SLAB, min(int(most_bits // ROWS).bit_length() - 1, int(max(1, total * CELLS) - 1).bit_length()))
    sketch = _build(spark, stored, bits)
    marked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = marked.schema["doc_id"].dataType.simpleString()
    marked = marked.mapInArrow(_mark(window, sketch, bits, with_text), f"doc_id {id_type}, n_words long, sha string, text binary, runs array<long>")
    marked = scratch.save(marked.withColumn("row", F.monotonically_increasing_id()), "marked")
    scratch.drop("anchors")
    sketch.destroy()

    # rows of the same words as one of a smaller id are removed as a whole: each of their windows starts there too
    light = marked.where((F.size("runs") > 0) & (F.col("n_words") >= window)).select("row", "doc_id", "sha")
    same = light.groupBy("sha").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    copies = scratch.save(light.join(same, "sha").where("doc_id is null or first < doc_id").select("row"), "copies")

    some = marked.where("size(runs) > 0").join(copies, "row", "left_anti").select("doc_id", "row", "text", "runs")
    rows = some.mapInArrow(_windows(window), f"a long, b long, doc_id {id_type}, row long, at int")
    first = rows.select("a", "b", "doc_id").groupBy("a", "b").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    # written, so that the join deals both sides anew and a window of many documents can be split
    first = scratch.save(first.select("a", "b", "first"), "first")
    hit = rows.join(first, ["a", "b"]).where("doc_id is null or first < doc_id")
    places = hit.groupBy("row").agg(F.collect_list("at").alias("at"))
    cut = some.select("row", "text").join(places, "row").select("row", "text", "at")
    cut = scratch.save(cut.mapInArrow(_cut(window), "row long, n_removed long, kept_sha256 string, kept_text string").select("row", "n_removed", "kept_sha256", *(["kept_text"] if with_text else [])), "cut")
    whole = marked.select("row", "doc_id", "n_words", "sha", *(["text"] if with_text else []))
    nothing = hashlib.sha256(b"").hexdigest()
    gone = marked.select("row", F.col("n_words").alias("n_removed")).join(copies, "row", "left_semi").withColumn("kept_sha256", F.lit(nothing))
    if with_text:
        gone = gone.withColumn("kept_text", F.lit(""))
    out = whole.join(cut.unionByName(gone), "row", "left")
    result = [F.col("doc_id"), F.col("n_words"), F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("kept_sha256", "sha").alias("kept_sha256")]
    if with_text:
        joined = F.trim(F.regexp_replace(F.col("text").cast("string"), r"[\x20\x09-\x0D]+", " "))
        result.append(F.coalesce("kept_text", joined).alias("kept_text"))
    return out.select(*result)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), v AS (
  SELECT doc_id, p, array_to_string(w[p:p + 49], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS p FROM d WHERE len(w) >= 50)
), f AS (
  SELECT s, min(doc_id) AS first FROM v GROUP BY s HAVING count(*) > 1
), gone AS (
  SELECT DISTINCT v.doc_id, unnest(range(v.p, v.p + 50)) AS q FROM v JOIN f USING (s) WHERE f.first < v.doc_id
), g AS (
  SELECT doc_id, list(q) AS qs, count(*) AS n FROM gone GROUP BY doc_id
), x AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(g.n, 0) AS n_removed,
    CASE WHEN g.qs IS NULL THEN w ELSE [w[i] FOR i IN range(1, len(w) + 1) IF NOT list_contains(g.qs, i)] END AS k
  FROM d LEFT JOIN g USING (doc_id)
)
SELECT doc_id, n_words, n_removed, sha256(coalesce(array_to_string(k, ' '), '')) AS kept_sha256 FROM x
"""
