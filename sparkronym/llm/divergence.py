"""How each source's use of terms diverges from the other sources' and from the language's.

Texts are read in slices: words are found and hashed as bytes, and each slice gives one
row for each (language, source, term) in it, with occurrences and documents. Sums of
these by term say which terms stand in enough documents of their language; others go no
further. The kept terms are sorted by ranges and numbered from 0 in their language:
these integers are in the order of UTF-8, so that any order by term is one by integer.

A language's numbers are cut into chunks. A task has one chunk: its kept terms as a
sorted array, in which searchsorted finds each row's number; bincount makes a dense
vector of counts for each source, and shares and divergences are arithmetic on these
vectors in 64-bit integers, exact. Chunks have CELLS numbers in all, however many
sources or terms there are, so that neither a language of all rows nor a term in all
documents is one task's. What is broadcast has a row for each (language, source) that
occurs, of which the result has a row for each two of a language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkronym.llm import words as w
from sparkronym.llm.common import Scratch, numbered, ship

#: Documents of its language that a term must stand in, ranks of terms that are returned, and the unit of shares.
MIN_DOCS, RANKS, UNIT = 3, 200, 1_000_000_000
#: Numbers in a task's dense vectors, bytes of a slice of texts.
CELLS, SLICE = 1 << 22, 8 << 20

#: What separates terms: all of ASCII but letters.
APART = np.ones(256, bool)
APART[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The spans of bytes as strings."""
    n = ends - starts
    off = np.zeros(len(n) + 1, np.int64)
    np.cumsum(n, out=off[1:])
    at = np.arange(off[-1]) + np.repeat(starts - off[:-1], n)
    return pa.LargeStringArray.from_buffers(len(n), pa.py_buffer(off), pa.py_buffer(data[at])).cast(pa.string())


def distinct(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each span, equal for equal bytes, and a span that has each number.

    By 64-bit hashes; spans of one hash are compared by a second, independent one and told
    apart by it, should they differ."""
    import pandas as pd

    first = w.hashes(data, starts, ends)
    code, _ = pd.factorize(first)
    where = np.zeros(code.max() + 1 if len(code) else 0, np.int64)
    where[code[::-1]] = np.arange(len(code))[::-1]
    second = w.hashes(data, starts, ends, 1)
    if (second != second[where[code]]).any():
        code, _ = pd.factorize(pd.MultiIndex.from_arrays([first, second]))
        where = np.zeros(code.max() + 1, np.int64)
        where[code[::-1]] = np.arange(len(code))[::-1]
    return code, where


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and how often each occurs."""
    keys = np.sort(keys)
    at = np.flatnonzero(np.concatenate((np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1])))
    return keys[at], np.diff(np.append(at, len(keys)))


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in w.slices(batch, "text", SLICE):
            data, off = w.text_bytes(part.column("text"))
            data = w.LOWER[data]
            starts, ends, of = w.spans(data, off, APART)
            if not len(starts):
                continue
            code, where = distinct(data, starts, ends)
            lang, source = (pc.dictionary_encode(part.column(c)) for c in ("lang", "source"))
            many = len(source.dictionary)
            group = np.asarray(lang.indices).astype(np.int64) * many + np.asarray(source.indices)
            n = len(where)
            doc = np.repeat(np.arange(len(part), dtype=np.int64), np.diff(of))
            key, times = _counted(doc * n + code)  # a document and a term
            key = group[key // n] * n + key % n
            order = np.argsort(key, kind="stable")
            key, times = key[order], times[order]
            at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            term, g = where[key[at] % n], key[at] // n
            yield pa.RecordBatch.from_arrays(
                [lang.dictionary.take(pa.array(g // many)), source.dictionary.take(pa.array(g % many)), strings(data, starts[term], ends[term]), pa.array(np.add.reduceat(times, at)), pa.array(np.diff(np.append(at, len(key))))],
                names=["lang", "source", "term", "n", "docs"],
            )


def shares(count: np.ndarray, whole) -> np.ndarray:
    """1 + floor(UNIT * (count + 1) / whole), exactly, digits by threes: wholes up to 9e15."""
    left, out = count + 1, 0
    for _ in range(3):
        left = left * 1000
        out = out * 1000 + left // whole
        left = left % whole
    return out + 1


def _chunk(groups):
    """A task's chunk: sums of divergences between sources, and the leading terms of each source."""

    def run(table: pa.Table) -> pa.Table:
        lang = table.column("lang")[0].as_py()
        sources, totals, vocabulary, total = groups.value[lang]
        order = np.argsort(np.asarray(table.column("_idx")))
        table = table.take(pa.array(order))
        terms = table.column("term").combine_chunks()
        kept = np.array([t.encode() for t in terms.to_pylist()], object)  # sorted, as the numbers are in the order of UTF-8
        by = table.column("by").combine_chunks()
        rows = by.flatten()
        named = np.array([s.encode() for s in rows.field("source").to_pylist()], object)
        word = kept[np.repeat(np.arange(len(kept)), np.diff(np.asarray(by.offsets)))]
        ids, at = np.searchsorted(kept, word), np.searchsorted(np.array([s.encode() for s in sources], object), named)
        n, s = len(kept), len(sources)
        count = np.bincount(at * n + ids, weights=np.asarray(rows.field("n")), minlength=s * n).astype(np.int64).reshape(s, n)
        p, q = shares(count, (totals + vocabulary)[:, None]), shares(count.sum(0), total + vocabulary)
        out: dict = {"source": [], "part": [], "item": [], "value": []}
        for a in range(s):
            sums = ((p[a] - p) ** 2 // p).sum(1)
            others = [b for b in range(s) if b != a]
            out["source"] += [sources[a]] * len(others)
            out["part"] += ["pair"] * len(others)
            out["item"] += [sources[b] for b in others]
            out["value"] += sums[others].tolist()
            more = np.flatnonzero((count[a] > 0) & (p[a] > q))
            f = (p[a, more] - q[more]) ** 2 // q[more]
            best = np.lexsort((more, -f))[:RANKS]
            out["source"] += [sources[a]] * len(best)
            out["part"] += ["term"] * len(best)
            out["item"] += terms.take(pa.array(more[best])).to_pylist()
            out["value"] += f[best].tolist()
        return pa.table({"lang": pa.array([lang] * len(out["item"]), pa.string()), "source": pa.array(out["source"], pa.string()), "part": pa.array(out["part"], pa.string()), "item": pa.array(out["item"], pa.string()), "value": pa.array(out["value"], pa.int64())})

    return run


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = MIN_DOCS, ranks: int = RANKS, cells: int = CELLS) -> DataFrame:
    """lang, source, part, item, value, rank, as the query's contract has it.

    part `pair`: each other source of the language, by the divergence of this source's
    shares from it, summed over all kept terms. part `term`: kept terms that the source has
    and of which its share is above the language's, by what each adds to the divergence from
    it; the first `ranks` (at most RANKS, which each chunk returns) of them. A share is
    1 + floor(10^9 (count + 1) / (N + V)); shares p and q diverge by floor((p - q)^2 / q).

    Nulls in text, language or source are the empty string, which is a value like others. A
    document without terms still makes its group occur; a language without kept terms has
    pairs of value 0; a single source has no pairs. Ties go by item in UTF-8. Repeated rows
    count each, and ids are not read. Very long texts are one slice each; their terms are
    counted whole. An empty table gives an empty result. Other columns are not read."""
    if ranks > RANKS:
        raise ValueError(f"ranks: {RANKS} at most")
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark, "divergence")
    plain = docs.select(*(F.coalesce(docs[c].cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))
    found = plain.mapInArrow(w.tidy(_gather), "lang string, source string, term string, n long, docs long")
    found = found.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    terms = found.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("by")).where(F.col("docs") >= min_docs).select("lang", "term", "by")
    terms = scratch.save(terms, "terms")
    coded = scratch.save(numbered(scratch, terms, "lang", ["term"], "sorted"), "coded")
    scratch.drop("terms", "sorted")

    occur = plain.select("lang", "source").distinct()
    sums = coded.select("lang", F.explode("by").alias("x")).groupBy("lang", F.col("x.source").alias("source")).agg(F.sum("x.n").alias("n"))
    sums = occur.join(sums, ["lang", "source"], "left").select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"))
    sizes = {r["lang"]: r["v"] for r in coded.groupBy("lang").agg(F.count("*").alias("v")).collect()}
    groups: dict = {}
    for lang, source, n in sorted((tuple(r) for r in sums.collect()), key=lambda r: (r[0].encode(), r[1].encode())):
        groups.setdefault(lang, ([], []))
        groups[lang][0].append(source)
        groups[lang][1].append(n)
    groups = {lang: (own, np.array(n, np.int64), sizes.get(lang, 0), int(sum(n))) for lang, (own, n) in groups.items()}
    wide = max(1, cells // max((len(own) for own, *_ in groups.values()), default=1))
    chunks = coded.groupBy("lang", F.expr(f"_idx div {wide}").alias("chunk"))
    values = chunks.applyInArrow(_chunk(spark.sparkContext.broadcast(groups)), "lang string, source string, part string, item string, value long")
    values = scratch.save(values, "values")

    other = occur.select("lang", F.col("source").alias("item"))
    zero = occur.join(other, "lang").where("source <> item").select("lang", "source", F.lit("pair").alias("part"), "item", F.lit(0).cast("long").alias("value"))
    out = values.unionByName(zero).groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    return out.withColumn("rank", rank.cast("int")).where((F.col("part") == "pair") | (F.col("rank") <= ranks))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), g AS (SELECT DISTINCT lang, source FROM d), t AS (
  SELECT r, lang, source, unnest(terms) AS term FROM d
), kept AS (
  SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 3
), v AS (SELECT lang, count(*)::HUGEINT AS v FROM kept GROUP BY lang), c AS (
  SELECT lang, source, term, count(*)::HUGEINT AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL
), n AS (SELECT lang, source, sum(n)::HUGEINT AS n FROM c GROUP BY ALL), cells AS (
  SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS c, 1 + (1000000000 * (coalesce(c.n, 0) + 1)) // (coalesce(n.n, 0) + v.v) AS p
  FROM g JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term LEFT JOIN n ON n.lang = g.lang AND n.source = g.source
), whole AS (
  SELECT lang, term, 1 + (1000000000 * (sum(n)::HUGEINT + 1)) // (sum(sum(n)::HUGEINT) OVER (PARTITION BY lang)::HUGEINT + any_value(v.v)) AS q FROM c JOIN v USING (lang) GROUP BY lang, term
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p)::BIGINT AS value
  FROM cells a JOIN cells b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
  UNION ALL
  SELECT a.lang, a.source, 'pair', b.source, 0 FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source WHERE a.lang NOT IN (SELECT lang FROM v)
), terms AS (
  SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM cells JOIN whole USING (lang, term) WHERE c > 0 AND p > q
)
SELECT lang, source, part, item, value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item))::INTEGER AS rank
FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms) QUALIFY part = 'pair' OR rank <= 200
"""
