"""Mixing sources to target weights by entropy balancing.

Among all non-negative document rates w that give each constraint its target of words,
the one of least relative entropy to "every document once", counted by words, is
w = exp(sum of the multipliers of the constraints that the document is under). The
multipliers solve a convex dual, sum of size * exp(a.l) - t.l, by damped Newton steps;
each step's gradient and Hessian are one distributed aggregation over the classes of
documents that are under the same constraints. Rates are then rounded into whole
copies, each document floor(w) or ceil(w) times: documents of one class and size are
alike, and errors are carried from the larger sizes to the smaller, so that a class
ends within about its smallest document of its target.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkronym.llm.common import WORD, Scratch, names, ship

#: Weights of the sources in order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: A source gives at most so many times its size, and a document so many copies.
MOST = 3


def n_words(text: str | Column) -> Column:
    """The number of words of the text; null has none."""
    c = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: dict, weights=WEIGHTS, most: float = MOST) -> dict:
    """What each source is to give of the sum of all sizes.

    Sources by code point, null last; weights repeat in that order. Whoever would be
    above most times its size stops there, and the excess is shared by weight among
    the others, until none is above."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in str(s)]) + [s for s in sizes if s is None]
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    left, free, out = float(sum(sizes.values())), list(order), {}
    while free:
        share = left / sum(weight[s] for s in free)
        full = [s for s in free if share * weight[s] > most * sizes[s]]
        if not full:
            out |= {s: share * weight[s] for s in free}
            break
        for s in full:
            out[s] = float(most * sizes[s])
            left -= out[s]
        free = [s for s in free if s not in out]
    return out


def balance(classes: DataFrame, constraints: dict[str, dict], size_col: str = "size", tolerance: float = 1e-9, most_steps: int = 200) -> tuple[list[tuple[str, object]], np.ndarray]:
    """The constraints' order and their multipliers.

    classes: one row per set of documents under the same constraints, with its words.
    constraints: column -> value -> target words. A target of 0 or an empty set is left
    out (its rate is 0 or of no effect). Where constraints contradict each other the
    steps end at the tolerance or their number, at the closest found."""
    names = [(c, v) for c, vs in constraints.items() for v, t in vs.items() if t > 0]
    goal = np.array([constraints[c][v] for c, v in names], float)
    lam = np.zeros(len(names))
    if not names:
        return names, lam
    scale = goal.sum()

    def terms(lam: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Value, gradient and Hessian: sums by the constraints that meet in a class."""
        cols = list(constraints)
        rate = F.lit(0.0)
        for c in cols:
            own = {v: x for (k, v), x in zip(names, lam, strict=True) if k == c}
            rate = rate + by_value(c, own, 0.0)
        mass = classes.groupBy(*cols).agg(F.sum(F.col(size_col) * F.exp(rate)).alias("m")).collect()
        at = {n: k for k, n in enumerate(names)}
        g, h, v = -goal.copy(), np.zeros((len(names), len(names))), 0.0
        for r in mass:
            k = [at[(c, r[c])] for c in cols if (c, r[c]) in at]
            v += r["m"] or 0.0
            g[k] += r["m"] or 0.0
            h[np.ix_(k, k)] += r["m"] or 0.0
        return v - goal @ lam, g, h

    value, g, h = terms(lam)
    for _ in range(most_steps):
        if np.abs(g).max() <= tolerance * scale:
            break
        step = np.linalg.lstsq(h + 1e-12 * scale * np.eye(len(names)), -g, rcond=None)[0]
        step *= min(1.0, 2.0 / max(np.abs(step).max(), 1e-300))
        size = 1.0
        while True:
            new = terms(lam + size * step)
            if new[0] <= value + 1e-4 * size * (g @ step) or size < 1e-6:
                break
            size /= 2
        lam, (value, g, h) = lam + size * step, new
    return names, lam


def by_value(c: str, values: dict, other: float) -> Column:
    """A literal for each value of the column, null included."""
    out = None
    for v, x in values.items():
        cond = F.col(c).isNull() if v is None else F.col(c) == F.lit(v)
        out = F.when(cond, F.lit(float(x))) if out is None else out.when(cond, F.lit(float(x)))
    return F.lit(other) if out is None else out.otherwise(F.lit(other))


def _round(key, rows):
    """For a class's sizes from the largest on: how many of the documents of that size get the larger number of copies."""
    rows = rows.sort_values("size", ascending=False)
    over, out = 0.0, []
    for s, n, w in zip(rows["size"].tolist(), rows["n"].tolist(), rows["rate"].tolist(), strict=True):
        base = int(np.floor(w + 1e-9))
        want = n * max(0.0, w - base) - over / s if s else 0.0
        up = int(min(n if w - base > 1e-9 else 0, max(0, round(want))))
        over = (up - want) * s
        out.append((base, up))
    rows["base"], rows["up"] = [b for b, _ in out], [u for _, u in out]
    return rows[["class", "size", "base", "up"]]


def mix(
    docs: DataFrame, targets_of, constraint_cols: tuple[str, ...] = ("source",), text_col: str = "text", id_col: str = "doc_id", most: int = MOST, keep: tuple[str, ...] = ()
) -> DataFrame:
    """One row per row of docs: id, constraint columns, size, keep columns, n_copies (0 to most).

    targets_of: sizes by value of the first column -> targets by value; for several
    columns, a dict column -> such a function. The table of constraint values goes to
    the driver: it has one row for each value met (sources, languages), not documents.
    Nulls are a value of their own, last in order; a null text has 0 words; documents
    of size 0 are taken once, as they count for nothing. Repeated rows are each
    taken or left by themselves, ties of the order broken by Spark's row number. An
    empty table gives an empty result. Reruns agree: the choice among documents of one
    class and size follows a hash of the id."""
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark, "mixing")
    cols = list(constraint_cols)
    sized = scratch.save(docs.select(F.col(id_col).alias("_id"), n_words(text_col).alias("size"), *cols, *keep), "sized")
    table = sized.groupBy(*cols).agg(F.sum("size").alias("size"), F.count("*").alias("rows"))
    classes = scratch.save(table, "classes")
    fns = targets_of if isinstance(targets_of, dict) else {cols[0]: targets_of}
    constraints = {}
    for c in cols:
        if c in fns:
            constraints[c] = fns[c]({r[c]: int(r["size"]) for r in classes.groupBy(c).agg(F.sum("size").alias("size")).collect()})
    names, lam = balance(classes, constraints)
    rate = F.lit(0.0)
    for c, vs in constraints.items():
        own = {v: x for (k, v), x in zip(names, lam, strict=True) if k == c}
        rate = rate + by_value(c, own | {v: -np.inf for v, t in vs.items() if t <= 0}, 0.0)
    rate = F.when(F.col("size") == 0, F.lit(1.0)).otherwise(F.least(F.exp(rate), F.lit(float(most))))

    # documents of a class and size are alike: numbers of copies are made by class and size
    cls = F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})
    blocks = int(min(4096, max(16, sized.count() // 800)))
    rows = sized.withColumn("class", cls).withColumn("_b", F.pmod(F.xxhash64(F.lit("mix"), "_id"), F.lit(blocks)))
    part = scratch.save(rows.groupBy("class", "size", *cols, "_b").agg(F.count("*").alias("n")), "parts")
    groups = part.groupBy("class", "size", *cols).agg(F.sum("n").alias("n")).withColumn("rate", rate)
    schema = T.StructType([T.StructField("class", T.StringType()), T.StructField("size", T.LongType()), T.StructField("base", T.LongType()), T.StructField("up", T.LongType())])
    ups = scratch.save(groups.select("class", "size", "n", "rate").groupBy("class").applyInPandas(_round, schema), "ups")
    from pyspark.sql import Window as W

    before = F.coalesce(F.sum("n").over(W.partitionBy("class", "size").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    start = part.withColumn("before", before).select("class", "size", "_b", "before").join(ups, ["class", "size"]).withColumn("take", F.col("up") - F.col("before"))
    start = scratch.save(start.select("class", "size", "_b", "base", "take"), "start")
    rank = F.row_number().over(W.partitionBy("class", "size", "_b").orderBy(F.xxhash64("_id", F.lit(1)), "_id"))
    out = rows.withColumn("_r", rank).join(start, ["class", "size", "_b"]).withColumn("n_copies", (F.col("base") + (F.col("_r") <= F.col("take")).cast("int")).cast("long"))
    out = out.select(F.col("_id").alias(id_col), *cols, "size", *(k for k in keep if k not in cols), "n_copies")
    out = scratch.save(out, "out")
    scratch.drop("sized", "classes", "parts", "ups", "start")
    return out


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with what the mix takes of them; target and source_size are their source's."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    seen: dict = {}

    def goals(sizes: dict) -> dict:
        seen["size"], seen["target"] = sizes, targets(sizes)
        return seen["target"]

    out = mix(docs, goals)
    return out.select(
        "doc_id", "source", "size", by_value("source", seen.get("size", {}), 0.0).cast("long").alias("source_size"),
        by_value("source", seen.get("target", {}), 0.0).alias("target"), (F.col("size") * F.col("n_copies")).alias("taken"), "n_copies",
    )


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of docs as often as the mix takes them, columns as they are whatever their names.

    Rows that share an id, null too, are told apart by their texts; rows that repeat id
    and text get the copies of the one of them with most. Null and empty texts have no
    words and stay once. An empty table gives an empty result."""
    key, other, n, k = names(docs, "key", "other", "n", "k")
    made = F.struct(F.col(id_col).alias("id"), F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("sha"))
    keyed = docs.withColumn(key, made)
    got = mix(keyed, targets, id_col=key, text_col=text_col, **how).groupBy(F.col(key).alias(other)).agg(F.max("n_copies").alias(n))
    out = keyed.join(got, F.col(key).eqNullSafe(F.col(other))).where(F.col(n) > 0)
    return out.withColumn(k, F.explode(F.sequence(F.lit(1), F.col(n).cast("int")))).select(*docs.columns)
