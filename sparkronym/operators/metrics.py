"""Scores of predictions against labelled data, agreement of annotators, and significance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sparkronym.functions.similarity import masi_distance, set_jaccard_distance, similar


def ratio(a: Column, b: Column) -> Column:
    """0 where the divisor is 0."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def f1(p: Column, r: Column) -> Column:
    return ratio(2 * p * r, p + r)


def match_pairs(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """Gold and predicted pairs (article_id, acronym, expansion) side by side.

    First by equal acronyms; what is left on both sides then by the acronym with or
    without a final s. Each prediction is used once, and unmatched rows of both sides stay."""
    g = gold.select("article_id", F.col("acronym").alias("gold_acronym"), F.col("expansion").alias("gold_expansion"))
    p = predicted.select("article_id", F.col("acronym").alias("pred_acronym"), F.col("expansion").alias("pred_expansion"))
    exact = g.join(p, (g["article_id"] == p["article_id"]) & (F.col("gold_acronym") == F.col("pred_acronym"))).drop(p["article_id"])
    g_left = g.join(p.select("article_id", F.col("pred_acronym").alias("gold_acronym")), ["article_id", "gold_acronym"], "left_anti")
    p_left = p.join(g.select("article_id", F.col("gold_acronym").alias("pred_acronym")), ["article_id", "pred_acronym"], "left_anti")
    stem = lambda c: F.regexp_replace(c, "s$", "")
    number = lambda c: F.row_number().over(W.partitionBy("article_id", "stem").orderBy(c))
    gs = g_left.withColumn("stem", stem("gold_acronym")).withColumn("k", number("gold_acronym"))
    ps = p_left.withColumn("stem", stem("pred_acronym")).withColumn("k", number("pred_acronym"))
    rest = gs.join(ps, ["article_id", "stem", "k"], "full").drop("stem", "k")
    return exact.unionByName(rest.select(*exact.columns))


def _hits(m: DataFrame) -> dict[str, Column]:
    both = F.col("gold_acronym").isNotNull() & F.col("pred_acronym").isNotNull()
    right = both & F.col("gold_expansion").isNotNull() & F.col("pred_expansion").isNotNull() & F.coalesce(similar("gold_expansion", "pred_expansion"), F.lit(False))
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    return {
        "gold_acronyms": n(F.col("gold_acronym").isNotNull()), "found_acronyms": n(F.col("pred_acronym").isNotNull()), "right_acronyms": n(both),
        "gold_expansions": n(F.col("gold_expansion").isNotNull()), "found_expansions": n(both & F.col("pred_expansion").isNotNull()), "right_expansions": n(right),
        "gold_pairs": n(F.col("gold_expansion").isNotNull()), "found_pairs": n(F.col("pred_expansion").isNotNull()), "right_pairs": n(right),
    }


def extraction_counts(gold: DataFrame, predicted: DataFrame, by: list[str] = ()) -> DataFrame:
    """Numbers of gold, found and right acronyms, expansions and pairs.

    A found expansion counts for expansions only if its acronym is gold, for pairs always."""
    m = match_pairs(gold, predicted)
    cols = [v.alias(k) for k, v in _hits(m).items()]
    return m.groupBy(*by).agg(*cols) if by else m.agg(*cols)


def precision_recall(counts: DataFrame, kinds: tuple[str, ...] = ("acronyms", "expansions", "pairs")) -> DataFrame:
    out = counts
    for k in kinds:
        p, r = ratio(F.col(f"right_{k}"), F.col(f"found_{k}")), ratio(F.col(f"right_{k}"), F.col(f"gold_{k}"))
        out = out.withColumn(f"{k}_precision", p).withColumn(f"{k}_recall", r).withColumn(f"{k}_f1", f1(p, r))
    return out


def module_counts(results: DataFrame) -> DataFrame:
    """Right, found and gold by module and in total, from rows (module, gold, found, right) of booleans; total: module null."""
    n = lambda c: F.sum(F.col(c).cast("long"))
    return results.rollup("module").agg(n("gold").alias("gold_pairs"), n("found").alias("found_pairs"), n("right").alias("right_pairs"))


def choices(gold: DataFrame, predicted: DataFrame, options: DataFrame | None = None) -> DataFrame:
    """Each gold (article_id, acronym, expansion) with the prediction, its success, whether the expansion was an
    option and whether the acronym had several."""
    g = gold.select("article_id", "acronym", F.col("expansion").alias("actual"))
    p = predicted.select("article_id", "acronym", F.col("expansion").alias("predicted"), "confidence")
    out = g.join(p, ["article_id", "acronym"], "left").withColumn("success", F.coalesce(F.col("actual") == F.col("predicted"), F.lit(False)))
    if options is None:
        return out
    out = out.join(options, "acronym", "left")
    return out.withColumn("in_db", F.coalesce(F.array_contains("options", F.col("actual")), F.lit(False))).withColumn("ambiguous", F.coalesce(F.col("n_options") > 1, F.lit(False))).drop("options", "n_options")


def accuracies(c: DataFrame, by: list[str] = ()) -> DataFrame:
    s = F.col("success").cast("double")
    cols = [F.count("*").alias("n"), F.avg(s).alias("accuracy"), F.avg(F.when(F.col("in_db"), s)).alias("accuracy_in_db"), F.avg(F.when(F.col("ambiguous"), s)).alias("accuracy_ambiguous")]
    return c.groupBy(*by).agg(*cols) if by else c.agg(*cols)


def _per_expansion(c: DataFrame) -> DataFrame:
    true = c.groupBy("acronym", F.col("actual").alias("expansion")).agg(F.count("*").alias("actual_n"), F.sum(F.col("success").cast("long")).alias("tp"))
    pred = c.where("predicted is not null").groupBy("acronym", F.col("predicted").alias("expansion")).agg(F.count("*").alias("predicted_n"))
    return true.join(pred, ["acronym", "expansion"], "full").fillna(0, ["actual_n", "tp", "predicted_n"])


def macro_by_expansion(c: DataFrame) -> DataFrame:
    """Mean precision (1 if never predicted), recall and F1 of gold expansions; the F1 is a mean of F1s."""
    e = _per_expansion(c).where("actual_n > 0")
    p = F.when(F.col("predicted_n") == 0, F.lit(1.0)).otherwise(F.col("tp") / F.col("predicted_n"))
    r = F.col("tp") / F.col("actual_n")
    return e.select(p.alias("p"), r.alias("r"), f1(p, r).alias("f")).agg(F.avg("p").alias("macro_precision"), F.avg("r").alias("macro_recall"), F.avg("f").alias("macro_f1"))


def macro_harmonic(c: DataFrame) -> DataFrame:
    """Macro precision and recall over all expansions met, their harmonic mean, and micro accuracy."""
    e = _per_expansion(c)
    m = e.agg(F.avg(ratio(F.col("tp"), F.col("predicted_n"))).alias("macro_precision"), F.avg(ratio(F.col("tp"), F.col("actual_n"))).alias("macro_recall"), ratio(F.sum("tp"), F.sum("actual_n")).alias("accuracy"), ratio(F.sum("tp"), F.sum("predicted_n")).alias("micro_precision"))
    return m.withColumn("macro_f1", f1(F.col("macro_precision"), F.col("macro_recall")))


def error_counts(c: DataFrame) -> DataFrame:
    """Per (acronym, expansion): right, predicted and actual numbers and F1."""
    e = _per_expansion(c)
    return e.withColumn("f1", f1(ratio(F.col("tp"), F.col("predicted_n")), ratio(F.col("tp"), F.col("actual_n"))))


def error_report(c: DataFrame, stats: DataFrame) -> DataFrame:
    """error_counts with the statistics of similar training expansions of the acronym."""
    e = error_counts(c)
    s = stats.withColumnRenamed("expansion", "train_expansion")
    return e.join(s, "acronym").where(similar("expansion", "train_expansion"))


def dictionary_scores(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """Dictionaries compared: unique acronyms by the smaller number of expansions, unique pairs by similarity."""
    uniq = lambda d, n: d.where("expansion is not null").groupBy("acronym").agg(F.collect_set("expansion").alias(n))
    j = uniq(gold, "g").join(uniq(predicted, "p"), "acronym", "full").withColumn("g", F.coalesce("g", F.array().cast("array<string>"))).withColumn("p", F.coalesce("p", F.array().cast("array<string>")))
    right = F.size(F.filter("g", lambda e: F.exists(F.col("p"), lambda x: similar(x, e))))
    j = j.select(F.size("g").alias("gn"), F.size("p").alias("pn"), right.alias("rn"), F.least(F.size("g"), F.size("p")).alias("an"))
    out = j.agg(F.sum("gn").alias("gold_pairs"), F.sum("pn").alias("found_pairs"), F.sum("rn").alias("right_pairs"), F.sum("an").alias("right_acronyms"))
    return precision_recall(out, ("pairs",))


def fold_summary(folds: DataFrame, metrics: list[str]) -> DataFrame:
    """Mean and population standard deviation over folds."""
    return folds.agg(*(x for m in metrics for x in (F.avg(m).alias(f"{m}_mean"), F.stddev_pop(m).alias(f"{m}_std"))))


def execution_times(runs: DataFrame) -> DataFrame:
    """Mean model time over folds, and test time for each article, from (fold, model_time, test_time, n_articles)."""
    return runs.agg(F.avg("model_time").alias("model_time"), ratio(F.sum("test_time"), F.sum("n_articles")).alias("time_per_article"))


def agreement(sets: DataFrame, distance: str = "jaccard") -> DataFrame:
    """Krippendorff's alpha and Cohen's kappa of two annotators' sets (doc_id, annotator, items).

    Documents count for which both sets are non-empty. Observed distances are within
    documents, expected ones between any two sets, by their distinct values and counts."""
    dist = set_jaccard_distance if distance == "jaccard" else masi_distance
    s = sets.select("doc_id", "annotator", F.array_sort(F.array_distinct("items")).alias("items")).where(F.size("items") > 0)
    both = s.groupBy("doc_id").agg(F.countDistinct("annotator").alias("n")).where("n = 2")
    s = s.join(both.select("doc_id"), "doc_id", "left_semi")
    a, b = s.where("annotator = 0").select("doc_id", F.col("items").alias("x")), s.where("annotator = 1").select("doc_id", F.col("items").alias("y"))
    observed = a.join(b, "doc_id").agg(F.avg(dist(F.col("x"), F.col("y"))).alias("observed"), F.count("*").alias("n_docs"))
    # sets at distance 1 are all those that share nothing: only pairs that share an item are made
    flat = s.select("annotator", "items").groupBy("annotator", "items").agg(F.count("*").alias("c")).withColumn("id", F.xxhash64("items", "annotator"))
    item = flat.select("id", "annotator", "items", "c", F.explode("items").alias("i"))
    l, r = item.select("i", F.col("id").alias("lid"), F.col("annotator").alias("la"), F.col("items").alias("x"), F.col("c").alias("lc")), item.select("i", F.col("id").alias("rid"), F.col("annotator").alias("ra"), F.col("items").alias("y"), F.col("c").alias("rc"))  # noqa: E741
    near = l.join(r, "i").dropDuplicates(["lid", "rid"]).withColumn("s", 1 - dist(F.col("x"), F.col("y")))
    same = near.agg(F.sum(F.col("lc") * F.col("rc") * F.col("s")).alias("all_s"), F.sum(F.when((F.col("la") == 0) & (F.col("ra") == 1), F.col("lc") * F.col("rc") * F.col("s"))).alias("ab_s"))
    out = observed.crossJoin(same)  # one row by one row
    n = F.col("n_docs") * 2
    expected_alpha = 1 - (F.col("all_s") - n) / (n * (n - 1))
    expected_kappa = 1 - F.coalesce("ab_s", F.lit(0.0)) / (F.col("n_docs") * F.col("n_docs"))
    alpha = 1 - ratio(F.col("observed"), expected_alpha)
    kappa = 1 - ratio(F.col("observed"), expected_kappa)
    return out.select("n_docs", F.col("observed").alias("observed_distance"), alpha.alias("alpha"), kappa.alias("kappa"))


def per_article(c: DataFrame) -> DataFrame:
    return c.groupBy("article_id").agg(F.sum(F.col("success").cast("long")).alias("successes"), F.count("*").alias("n")).withColumn("accuracy", F.col("successes") / F.col("n"))


def confidence_correlation(c: DataFrame) -> DataFrame:
    """Of the confidence, scaled to its largest, with success."""
    top = c.agg(F.max("confidence").alias("top"))
    return c.crossJoin(F.broadcast(top)).agg(F.corr(F.col("confidence") / F.col("top"), F.col("success").cast("double")).alias("correlation"))  # one row


def confidence_report(scored: DataFrame, results: DataFrame, expanders: list[str]) -> DataFrame:
    """Expanders' best confidences and successes side by side, and whether some are right and some wrong.

    scored: (expander, article_id, acronym, confidence); results: (expander, article_id, acronym, success)."""
    keys = ["article_id", "acronym"]
    conf = scored.groupBy(*keys).pivot("expander", expanders).agg(F.max("confidence"))
    conf = conf.select(*keys, *(F.col(e).alias(f"{e}_confidence") for e in expanders))
    ok = results.groupBy(*keys).pivot("expander", expanders).agg(F.max(F.col("success").cast("int")))
    ok = ok.select(*keys, *(F.col(e).alias(f"{e}_success") for e in expanders))
    out = conf.join(ok, keys, "full")
    s = [F.coalesce(F.col(f"{e}_success"), F.lit(0)) for e in expanders]
    differ = F.greatest(*s) != F.least(*s) if len(s) > 1 else F.lit(False)
    return out.withColumn("some_right_some_wrong", differ)


def _rounds(values: DataFrame, rounds: int, draw: str, seed: int) -> DataFrame:
    """(round, s, k): sums over values (value, n) of value times a draw for its n rows, and of the draws alone.

    Equal values are one row with their number, so that work is values times rounds however many rows there are.
    draw: how many of n rows are swapped ("half") or how often n rows are drawn again ("again"); draws follow from
    the value and the seed, whatever task the value is in. A task returns one row for each round."""
    import numpy as np
    import pyarrow as pa

    def run(batches):
        s, k = np.zeros(rounds), np.zeros(rounds)
        for batch in batches:
            for v, n in zip(batch.column("value").to_pylist(), batch.column("n").to_pylist(), strict=True):
                rng = np.random.default_rng([seed, int(np.float64(v).view(np.uint64))])
                x = n - 2 * rng.binomial(n, 0.5, rounds) if draw == "half" else rng.poisson(n, rounds)
                s += v * x
                k += x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(1, rounds + 1)), pa.array(s), pa.array(k)], names=["round", "s", "k"])

    folded = values.where("value is not null").select((F.col("value").cast("double") + 0.0).alias("value")).groupBy("value").agg(F.count("*").alias("n"))  # 0 has no sign
    return folded.mapInArrow(run, "round long, s double, k double").groupBy("round").agg(F.sum("s").alias("s"), F.sum("k").alias("k"))


def randomisation_test(pairs: DataFrame, rounds: int = 1000, seed: int = 0) -> DataFrame:
    """Paired randomisation: (item, a, b) -> observed difference of means and the share of rounds, in each of which
    each item is swapped or not with equal chance, with at least that difference.

    Items of one difference are alike: how many of them are swapped is one binomial draw. Items without both
    values are left out."""
    d = pairs.select((F.col("a") - F.col("b")).cast("double").alias("value"))
    seen = d.agg(F.abs(F.avg("value")).alias("observed"), F.count("value").alias("n"))
    by_round = _rounds(d, rounds, "half", seed).crossJoin(F.broadcast(seen))  # one row
    return by_round.agg(F.max("observed").alias("observed"), F.avg((F.abs(ratio(F.col("s"), F.col("n"))) >= F.col("observed") - 1e-12).cast("double")).alias("p_value"))


def bootstrap(values: DataFrame, rounds: int = 10_000, level: float = 0.9, seed: int = 0, value_col: str = "value", id_col: str = "item") -> DataFrame:
    """Percentile interval of the mean: each item is in a round as often as a Poisson variable of mean 1 says, so
    that items of one value are so as often as one of their number's mean. Null values are left out."""
    means = _rounds(values.select(F.col(value_col).cast("double").alias("value")), rounds, "again", seed).select(ratio(F.col("s"), F.col("k")).alias("m"))
    tail = (1 - level) / 2
    return means.agg(F.percentile("m", tail).alias("low"), F.avg("m").alias("mean"), F.percentile("m", 1 - tail).alias("high"))


def explain_errors(report: DataFrame, target: str = "f1", depth: int = 3):
    """A regression tree on the acronyms' statistics: (model, its rules as text)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import DecisionTreeRegressor

    cols = ["acronym_len", "acronym_count", "exp_freq", "expansion_count"]
    model = Pipeline(stages=[VectorAssembler(inputCols=cols, outputCol="features"), DecisionTreeRegressor(maxDepth=depth, labelCol=target, seed=0)]).fit(report)
    text = model.stages[-1].toDebugString
    for k, c in enumerate(cols):
        text = text.replace(f"feature {k} ", f"{c} ")
    return model, text
