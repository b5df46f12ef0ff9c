"""Choosing among an acronym's candidate expansions: out-of-text expansion.

Every expander gives scores (article_id, acronym, expansion, confidence), one row for each
option; choose() takes the best, of equals the first by text. Expanders that learn are
fitted once for each acronym, by grouped functions; training rows are those of the
dictionary, so a group is an acronym's own articles.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sparkronym.functions.similarity import cosine, normalised_confidences
from sparkronym.functions.text import stable_hash
from sparkronym.operators.dictionary import most_frequent as _frequent
from sparkronym.shipping import ship
from sparkronym.storage import Steps

KEYS = ["article_id", "acronym"]


def choose(scores: DataFrame) -> DataFrame:
    """The option of the largest confidence; of equals the first by text."""
    per = W.partitionBy(*KEYS).orderBy(F.desc("confidence"), "expansion")
    return scores.withColumn("rank", F.row_number().over(per)).where("rank = 1").select(*KEYS, "expansion", "confidence")


def option_maps(scores: DataFrame) -> DataFrame:
    return scores.groupBy(*KEYS).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("expansion", "confidence")))).alias("options"))


def random_choice(mentions: DataFrame, options: DataFrame, seed: int = 0) -> DataFrame:
    """Uniform by a hash of article, acronym and seed; confidence 1/n."""
    m = mentions.select(*KEYS).distinct().join(options, "acronym")
    k = F.pmod(stable_hash(seed, "article_id", "acronym"), F.col("n_options").cast("long")).cast("int")
    return m.select(*KEYS, F.try_element_at(F.sort_array("options"), k + 1).alias("expansion"), (F.lit(1.0) / F.col("n_options")).alias("confidence"))


def most_frequent(mentions: DataFrame, dictionary: DataFrame) -> DataFrame:
    return mentions.select(*KEYS).distinct().join(_frequent(dictionary), "acronym").select(*KEYS, "expansion", "confidence")


def cosine_scores(mentions: DataFrame, dictionary: DataFrame, test_vectors: DataFrame, train_vectors: DataFrame) -> DataFrame:
    """For each option the largest cosine of its training articles with the test article, at least 0.

    Vectors are sparse (article_id, term, weight): a join on acronym and term, so that
    only terms that both sides have are met, and no pair of articles is made without.
    Equal vectors are one on both sides, however many mentions or articles have them.
    Mentions and the dictionary may name their vectors: see named()."""
    steps = Steps(mentions.sparkSession, "cosine")
    tests = named(mentions, test_vectors, ["acronym"])
    number = F.monotonically_increasing_id()  # short names while pairs are added up
    near = steps.cut(_folded(tests, ["acronym"], test_vectors).withColumn("near", number))
    train = named(dictionary.select("acronym", "expansion", *("same" if "same" in dictionary.columns else "article_id",)), train_vectors, ["acronym", "expansion"])
    train = steps.cut(_folded(train, ["acronym", "expansion"], train_vectors).withColumn("other", number))
    flat = lambda df, w, *c: unit(df).select("acronym", *c, F.explode("bag").alias("x")).select("acronym", *c, "x.term", F.col("x.weight").alias(w))
    sims = flat(near, "weight", "near").join(flat(train, "tw", "expansion", "other"), ["acronym", "term"]).groupBy("near", "expansion", "other").agg(F.sum(F.col("weight") * F.col("tw")).alias("cos"))
    best = sims.groupBy("near", "expansion").agg(F.greatest(F.lit(0.0), F.max("cos")).alias("confidence"))
    # every mention has all options; what is joined to mentions is written first, so that Spark knows when it is small
    options = dictionary.select("acronym", "expansion").distinct()
    best = steps.cut(near.select("acronym", "same", "near").join(options, "acronym").join(best, ["near", "expansion"], "left").groupBy("acronym", "same").agg(F.collect_list(F.struct("expansion", F.coalesce("confidence", F.lit(0.0)).alias("confidence"))).alias("o")))
    none = steps.cut(options.groupBy("acronym").agg(F.collect_list(F.struct("expansion", F.lit(0.0).alias("confidence"))).alias("none")))
    every = tests if "same" in mentions.columns else mentions.select(*KEYS).distinct().join(tests.select(*KEYS, "same"), KEYS, "left")
    every = every.join(none, "acronym").join(best, ["acronym", "same"], "left")
    return every.select(*KEYS, F.explode(F.coalesce("o", "none")).alias("x")).select(*KEYS, "x.expansion", "x.confidence")


def named(rows: DataFrame, vectors: DataFrame, by: list[str]) -> DataFrame:
    """Distinct rows (article_id, ...) with their article's vector, a bag array<struct<term, weight>>, and its name: equal
    names have equal vectors. Articles without a vector are left out.

    Rows that have a name already, same, are distinct and stay as they are; vectors are then (same, bag)."""
    if "same" in rows.columns:
        return rows
    bags = vectors.groupBy("article_id").agg(F.array_sort(F.collect_list(F.struct("term", F.col("weight").cast("double").alias("weight")))).alias("bag"))
    out = rows.select("article_id", *by).distinct().join(bags, "article_id")
    return out.withColumn("same", F.sha2(F.to_json("bag"), 256))


def _folded(rows: DataFrame, by: list[str], vectors: DataFrame | None = None) -> DataFrame:
    """Each different vector of named() once for the columns by: (by, same, bag, n), n of how many rows."""
    if "bag" not in rows.columns:
        return rows.groupBy(*by, "same").agg(F.count("*").alias("n")).join(vectors, "same")
    return rows.groupBy(*by, "same").agg(F.first("bag").alias("bag"), F.count("*").alias("n"))


def unit(rows: DataFrame) -> DataFrame:
    """Bags of length 1; those of length 0 are left out."""
    rows = rows.withColumn("length", F.sqrt(F.aggregate("bag", F.lit(0.0), lambda s, x: s + x["weight"] * x["weight"]))).where("length > 0")
    return rows.withColumn("bag", F.transform("bag", lambda x: F.named_struct(F.lit("term"), x["term"], F.lit("weight"), F.try_divide(x["weight"], F.col("length"))))).drop("length")


def dense_cosine_scores(mentions: DataFrame, dictionary: DataFrame, test_vectors: DataFrame, train_vectors: DataFrame) -> DataFrame:
    """The same for dense vectors (article_id, vector)."""
    t = dictionary.select("acronym", "expansion", F.col("article_id").alias("train_id")).distinct().join(train_vectors.select(F.col("article_id").alias("train_id"), F.col("vector").alias("tv")), "train_id")
    m = mentions.select(*KEYS).distinct().join(test_vectors, "article_id")
    sims = m.join(t, "acronym").withColumn("cos", cosine("vector", "tv"))
    return sims.groupBy(*KEYS, "expansion").agg(F.greatest(F.lit(0.0), F.max("cos")).alias("confidence"))


#: Blocks on each side of a tile: a row goes to a task once for each tile of a side, where its blocks meet one after the other.
TILE = 16


def packed(vector_col: str = "vector"):
    """Vectors as bytes, as floats where these are exact."""

    @F.pandas_udf("binary")
    def run(v: pd.Series) -> pd.Series:
        def one(x):
            if x is None:
                return None
            d = np.asarray(x, float)
            with np.errstate(over="ignore"):
                f = d.astype(np.float32)
            return (b"f" + f.tobytes()) if np.array_equal(f, d, equal_nan=True) else b"d" + d.tobytes()

        return v.map(one)

    return run(vector_col)


def unit_rows(v: pd.Series, odd: bool = False) -> np.ndarray:
    """A matrix of packed vectors, each of length 1 or 0. odd: those with NaN or infinity stay NaN, else they are 0."""
    x = np.array([np.frombuffer(b, np.float32 if b[:1] == b"f" else np.float64, offset=1) for b in v], dtype=float)
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    return np.divide(x, norm, out=np.zeros_like(x), where=norm != 0 if odd else norm > 0)


def _spans(n: int, block_rows: int):
    return [slice(k, min(n, k + block_rows)) for k in range(0, n, block_rows)]


def dense_cosine_others(rows: DataFrame, block_rows: int = 1024) -> DataFrame:
    """For each row of (article_id, acronym, expansion, vector) and option of its acronym the largest cosine with
    another row of that option, at least 0. article_id is unique in an acronym.

    Each pair of blocks of rows is one product of matrices; a task has those of a tile of TILE by TILE blocks."""
    ship(rows.sparkSession)
    top = rows.groupBy("acronym").count().agg(F.max("count")).first()[0] or 1
    n = -(-top // (block_rows * TILE))
    b = rows.select(*KEYS, "expansion", packed().alias("vector"), F.pmod(F.xxhash64("article_id"), F.lit(n)).cast("int").alias("own"))
    every = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = b.select("acronym", "article_id", "vector", F.col("own").alias("i"), every.alias("j"))
    right = b.select("acronym", "article_id", "expansion", "vector", F.col("own").alias("j"), every.alias("i"))

    def one(key, a: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(t):
            return pd.DataFrame(columns=["article_id", "acronym", "labels", "scores"])
        t = t.sort_values("expansion", ignore_index=True)
        labels, code = np.unique(t["expansion"].to_numpy(), return_inverse=True)
        at = pd.Series(t.index, index=t["article_id"]).reindex(a["article_id"]).to_numpy()
        u, w = unit_rows(a["vector"]), unit_rows(t["vector"])
        best = np.zeros((len(a), len(labels)))
        for x in _spans(len(a), block_rows):
            for y in _spans(len(t), block_rows):
                cos = u[x] @ w[y].T
                same = (at[x] >= y.start) & (at[x] < y.stop)  # nan: not here
                cos[np.flatnonzero(same), (at[x][same] - y.start).astype(int)] = 0.0
                first = np.flatnonzero(np.diff(code[y], prepend=-1))
                own = code[y][first]
                best[x, own] = np.maximum(best[x, own], np.maximum.reduceat(cos, first, axis=1))
        return pd.DataFrame({"article_id": a["article_id"], "acronym": key[0], "labels": [labels] * len(a), "scores": list(best)})

    keys = ["acronym", "i", "j"]
    near = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(one, "article_id string, acronym string, labels array<string>, scores array<double>")
    near = near.select(*KEYS, F.explode(F.arrays_zip("labels", "scores")).alias("x"))
    return near.groupBy(*KEYS, F.col("x.labels").alias("expansion")).agg(F.max("x.scores").alias("confidence"))


def cosine_pairs(rows: DataFrame, block_rows: int = 1500) -> DataFrame:
    """(a, b, cos), a < b: the cosine, to 8 places, of each two rows of (id, block, vector) of the same block.

    A block of any size is cut into parts of about so many rows; each two parts are one product of matrices. A pair with a
    null vector, or one of another length, has no cosine."""
    from pyspark.sql.pandas.types import to_arrow_type

    ship(rows.sparkSession)
    rows = rows.where("block is not null and id is not null")
    sizes = Steps(rows.sparkSession, "pairs").cut(rows.groupBy("block").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("parts")))
    b = rows.join(sizes, "block").select("block", "id", packed().alias("vector"), F.pmod(F.xxhash64("id"), "parts").cast("int").alias("own"), "parts")
    below, above = F.explode(F.sequence(F.lit(0), F.col("own"))), F.explode(F.sequence(F.col("own"), F.col("parts") - 1))
    side = lambda own, other, every: b.select(F.col("block").alias("block"), F.col("id").alias("id"), F.col("vector").alias("vector"), F.col("own").alias(own), every.alias(other))
    kind = rows.schema["id"].dataType

    def one(key, left: pa.Table, right: pa.Table) -> pa.Table:
        left, right = left.to_pandas(), right.to_pandas()
        a, b = left["id"].to_numpy(), right["id"].to_numpy()
        width = lambda v: np.array([-1 if x is None else (len(x) - 1) // (4 if x[:1] == b"f" else 8) for x in v], int)
        m, n = width(left["vector"]), width(right["vector"])
        cos, none = np.zeros((len(a), len(b))), (m[:, None] != n[None, :]) | (m[:, None] < 0)
        for k in set(m[m > 0]) & set(n[n > 0]):
            cos[np.ix_(m == k, n == k)] = np.round(unit_rows(left["vector"][m == k], True) @ unit_rows(right["vector"][n == k], True).T, 8)
        use = a[:, None] < b[None, :] if key[1] == key[2] else np.ones(cos.shape, bool)
        i, j = np.nonzero(use)
        x, y = a[i], b[j]
        return pa.table({"a": pa.array(np.minimum(x, y), to_arrow_type(kind)), "b": pa.array(np.maximum(x, y), to_arrow_type(kind)), "cos": pa.array(cos[use], pa.float64(), mask=none[use])})

    keys = ["block", "i", "j"]
    sides = (side("i", "j", above).groupBy(*keys), side("j", "i", below).groupBy(*keys))
    return sides[0].cogroup(sides[1]).applyInArrow(one, f"a {kind.simpleString()}, b {kind.simpleString()}, cos double")


def term_cosine_scores(mentions: DataFrame, terms: DataFrame, test_vectors: DataFrame) -> DataFrame:
    """Cosine of the article with each option's own vector: terms (acronym, expansion, vector)."""
    m = mentions.select(*KEYS).distinct().join(test_vectors, "article_id")
    return m.join(terms.withColumnRenamed("vector", "tv"), "acronym").select(*KEYS, "expansion", F.greatest(F.lit(0.0), cosine("vector", "tv")).alias("confidence"))


def vote_scores(windows: DataFrame, terms: DataFrame) -> DataFrame:
    """Windows about each occurrence (article_id, acronym, at, vector) vote: the mean cosine with each option."""
    j = windows.join(terms.withColumnRenamed("vector", "tv"), "acronym").withColumn("cos", cosine("vector", "tv"))
    return j.groupBy(*KEYS, "expansion").agg(F.avg("cos").alias("confidence"))


def nearest(vectors: DataFrame, train: DataFrame, block_rows: int = 1024) -> DataFrame:
    """The nearest other training vector: vectors (id, block, vector), train (train_id, label, block, vector) of a block.

    (id, train_id, label, cos), of equally near ones the smallest train_id. A block of any size is cut into parts of
    about so many rows; each two of them are one product of matrices, of which a row for each id is left. A task has
    a tile of TILE by TILE of them."""
    ship(vectors.sparkSession)
    most = lambda df: df.groupBy("block").count().agg(F.max("count")).first()[0] or 1
    n, m = (-(-most(df) // (block_rows * TILE)) for df in (vectors, train))
    part = lambda c, k: F.pmod(F.xxhash64(c), F.lit(k)).cast("int")
    spread = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    left = vectors.select("block", "id", packed().alias("vector"), part("id", n).alias("i")).select("*", spread(m).alias("j"))
    right = train.select("block", "train_id", "label", packed().alias("vector"), part("train_id", m).alias("j")).select("*", spread(n).alias("i"))
    kind = {f.name: f.dataType.simpleString() for f in (*vectors.schema, *train.schema)}
    out = f"id {kind['id']}, train_id {kind['train_id']}, label {kind['label']}, cos double"

    def one(a: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(t):
            return pd.DataFrame(columns=["id", "train_id", "label", "cos"])
        t = t.sort_values("train_id", ignore_index=True)
        u, w, ids, others = unit_rows(a["vector"]), unit_rows(t["vector"]), a["id"].to_numpy(), t["train_id"].to_numpy()
        best, at = np.full(len(a), -2.0), np.zeros(len(a), int)
        for x in _spans(len(a), block_rows):
            for y in _spans(len(t), block_rows):
                cos = (u[x] @ w[y].T).round(12)
                cos[ids[x][:, None] == others[y][None, :]] = -2.0
                k = cos.argmax(1)
                top = cos[np.arange(len(k)), k]
                more = top > best[x]  # blocks come by train_id: of equals the first stays
                best[x], at[x] = np.where(more, top, best[x]), np.where(more, y.start + k, at[x])
        got = pd.DataFrame({"id": ids, "train_id": others[at], "label": t["label"].to_numpy()[at], "cos": best})
        return got[got["cos"] > -2.0]

    keys = ["block", "i", "j"]
    near = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(one, out)
    return near.groupBy("id").agg(F.min_by(F.struct("train_id", "label", "cos"), F.struct((-F.col("cos")).alias("c"), "train_id")).alias("m")).select("id", "m.*")


def fill_options(scores: DataFrame, options: DataFrame) -> DataFrame:
    """Confidences for models that only choose: the chosen's own if positive, else 1; the others 0."""
    chosen = scores.withColumnRenamed("expansion", "chosen")
    j = chosen.join(options, "acronym").select(*KEYS, "chosen", "confidence", F.explode("options").alias("expansion"))
    own = F.when(F.col("confidence") > 0, F.col("confidence")).otherwise(F.lit(1.0))
    return j.select(*KEYS, "expansion", F.when(F.col("expansion") == F.col("chosen"), own).otherwise(F.lit(0.0)).alias("confidence"))


# -- fitted for each acronym -------------------------------------------------------------------------

SCORES = "article_id string, acronym string, expansion string, confidence double"


def _matrix(rows: pd.DataFrame, terms: dict) -> np.ndarray:
    x = np.zeros((len(rows), len(terms)))
    for i, (t, v) in enumerate(zip(rows["terms"], rows["weights"], strict=True)):
        for a, b in zip(t, v, strict=True):
            if a in terms:
                x[i, terms[a]] = b
    return x


def linear(loss: str, c: float, penalty: str, balanced: bool, steps: int = 300):
    """One-against-rest linear models by proximal gradient steps: logistic or squared hinge loss, l1 or l2."""

    def fit(x: np.ndarray, y: np.ndarray, n: np.ndarray, labels: list[str]):
        x1, rows = np.c_[x, np.ones(len(x))], n.sum()
        lip = (0.25 if loss == "logistic" else 2.0) * c * max(1e-9, np.linalg.norm(x1 * np.sqrt(n)[:, None], 2) ** 2) * (rows if balanced else 1) + 1
        weights = np.zeros((x1.shape[1], len(labels)))
        for k in range(len(labels)):
            t = np.where(y == k, 1.0, -1.0)
            s = n * np.where(t > 0, rows / (2 * max(1, n[t > 0].sum())), rows / (2 * max(1, n[t < 0].sum()))) if balanced else n
            w = np.zeros(x1.shape[1])
            for _ in range(steps):
                m = t * (x1 @ w)
                g = -t / (1 + np.exp(np.clip(m, -30, 30))) if loss == "logistic" else -2 * t * np.maximum(0, 1 - m)
                w = w - (c * x1.T @ (s * g) + (w if penalty == "l2" else 0)) / lip
                if penalty == "l1":
                    w = np.sign(w) * np.maximum(0, np.abs(w) - 1 / lip)
            weights[:, k] = w

        def predict(z: np.ndarray) -> np.ndarray:
            out = np.c_[z, np.ones(len(z))] @ weights
            if loss == "logistic":
                p = 1 / (1 + np.exp(-np.clip(out, -30, 30)))
                return p / p.sum(1, keepdims=True)
            return out

        return predict

    return fit


def forest(trees: int = 100, max_features: str = "sqrt", depth: int = 12, seed: int = 123456):
    """Randomised decision trees over bootstrap rows; the share of trees that vote for a label."""
    root = {"none": lambda n: n, "root3": lambda n: round(n ** (1 / 3)), "root4": lambda n: round(n**0.25), "sqrt": lambda n: int(n**0.5), "log2": lambda n: int(np.log2(max(2, n)))}[max_features]

    def grow(x, y, n, n_labels, rng, level):
        counts = np.bincount(y, n, n_labels)
        if level == 0 or (counts > 0).sum() < 2:
            return int(counts.argmax())
        best = None
        for f in rng.permutation(x.shape[1])[: max(1, root(x.shape[1]))]:
            cut = np.unique(x[:, f])
            for v in (cut[:-1] + cut[1:]) / 2 if len(cut) > 1 else ():
                left = x[:, f] <= v
                score = sum(n[m].sum() * (1 - ((np.bincount(y[m], n[m], n_labels) / n[m].sum()) ** 2).sum()) for m in (left, ~left))
                if best is None or score < best[0]:
                    best = (score, f, v, left)
        if best is None:
            return int(counts.argmax())
        _, f, v, left = best
        return (f, v, grow(x[left], y[left], n[left], n_labels, rng, level - 1), grow(x[~left], y[~left], n[~left], n_labels, rng, level - 1))

    def fit(x, y, n, labels):
        rng, grown = np.random.default_rng(seed), []
        for _ in range(trees):
            drawn = rng.multinomial(int(n.sum()), n / n.sum())  # how often a bootstrap of all rows has each
            has = drawn > 0
            grown.append(grow(x[has], y[has], drawn[has].astype(float), len(labels), rng, depth))

        def predict(z):
            votes = np.zeros((len(z), len(labels)))
            for tree in grown:
                todo = [(tree, np.arange(len(z)))]
                while todo:
                    node, at = todo.pop()
                    if isinstance(node, tuple):
                        left = z[at, node[0]] <= node[1]
                        todo += [(node[2], at[left]), (node[3], at[~left])]
                    else:
                        votes[at, node] += 1
            return votes / trees

        return predict

    return fit


#: Rows of a matrix of test vectors, and different test vectors that a task gets at once, about.
CHUNK, PART = 2048, 16_384


def fitted(mentions: DataFrame, dictionary: DataFrame, test_vectors: DataFrame, train_vectors: DataFrame, model: Callable) -> DataFrame:
    """Scores by a model fitted once for each acronym on its training articles.

    model: (training matrix, labels, how many rows each row stands for, label names) -> a
    function from a test matrix to scores by test row and label. A group of training rows holds the
    different vectors of one acronym, with how many articles have each. Different test vectors are
    answered once, in parts of PART at most about, so that no task holds those of a hot acronym, CHUNK rows
    at a time, and joined to the mentions that have them. Binary margins
    give the loser 0. Mentions may name their vectors: see named()."""
    from pyspark import cloudpickle

    ship(mentions.sparkSession)
    steps = Steps(mentions.sparkSession, "fitted")
    pack = lambda df, *c: df.select("acronym", *c, "same", F.col("bag.term").alias("terms"), F.col("bag.weight").alias("weights"))
    tests = named(mentions, test_vectors, ["acronym"])
    train = pack(_folded(named(dictionary.select("acronym", "expansion", "article_id"), train_vectors, ["acronym", "expansion"]), ["acronym", "expansion"]), "expansion", "n")

    def fit(key, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["expansion", "same"])
        terms = {t: i for i, t in enumerate(sorted({t for ts in rows["terms"] for t in ts}))}
        labels = sorted(rows["expansion"].unique())
        y = rows["expansion"].map({e: i for i, e in enumerate(labels)}).to_numpy()
        predict = model(_matrix(rows, terms), y, rows["n"].to_numpy(float), labels) if len(labels) > 1 else None
        return pd.DataFrame({"acronym": [key[0]], "model": [cloudpickle.dumps((terms, labels, predict))]})

    def one(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame(columns=["same", "acronym", "labels", "scores"])
        terms, labels, predict = cloudpickle.loads(right["model"].iloc[0])
        left = left.sort_values("same", ignore_index=True)
        if predict is None:
            s = np.ones((len(left), 1))
        else:
            s = np.concatenate([predict(_matrix(left[k : k + CHUNK], terms)) for k in range(0, len(left), CHUNK)])
            if len(labels) == 2:  # margins of two labels: the winner's, and 0
                s = np.where((s < 0).any(1, keepdims=True), np.where(s >= s.max(1, keepdims=True), np.abs(s), 0.0), s)
        return pd.DataFrame({"same": left["same"], "acronym": key[0], "labels": [labels] * len(left), "scores": list(s)})

    folded = steps.cut(pack(_folded(tests, ["acronym"], test_vectors)))
    sizes = steps.cut(folded.groupBy("acronym").agg(F.ceil(F.count("*") / PART).alias("parts")))  # a row for each acronym
    folded = folded.join(sizes, "acronym").withColumn("part", F.pmod(F.xxhash64("same"), "parts"))
    models = train.groupBy("acronym").applyInPandas(fit, "acronym string, model binary").join(sizes, "acronym")
    models = models.select("acronym", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), "model")
    keys = ["acronym", "part"]
    got = folded.groupBy(*keys).cogroup(models.groupBy(*keys)).applyInPandas(one, "same string, acronym string, labels array<string>, scores array<double>")
    got = steps.cut(got)  # written first: Spark knows when it is small
    out = tests.join(got, ["acronym", "same"]).select(*KEYS, F.explode(F.arrays_zip("labels", "scores")).alias("x"))
    return out.select(*KEYS, F.col("x.labels").alias("expansion"), F.col("x.scores").alias("confidence"))


def logistic(mentions, dictionary, test_vectors, train_vectors, penalty="l2", c=0.1):
    return fitted(mentions, dictionary, test_vectors, train_vectors, linear("logistic", c, penalty, False))


def svm(mentions, dictionary, test_vectors, train_vectors, penalty="l2", c=1.0, balanced=False):
    return fitted(mentions, dictionary, test_vectors, train_vectors, linear("hinge2", c, penalty, balanced))


def random_forest(mentions, dictionary, test_vectors, train_vectors, trees=100, max_features="sqrt"):
    return fitted(mentions, dictionary, test_vectors, train_vectors, forest(trees, max_features))


# -- ensembles: scores of several expanders, with a column expander ------------------------------------


def hard_vote(scores: DataFrame) -> DataFrame:
    """One vote of each expander for its best option."""
    per = W.partitionBy("expander", *KEYS).orderBy(F.desc("confidence"), "expansion")
    top = scores.withColumn("rank", F.row_number().over(per)).withColumn("vote", (F.col("rank") == 1).cast("double"))
    return top.groupBy(*KEYS, "expansion").agg(F.sum("vote").alias("confidence"))


def soft_vote(scores: DataFrame) -> DataFrame:
    """The sum of each expander's normalised confidences."""
    maps = scores.groupBy("expander", *KEYS).agg(F.map_from_entries(F.collect_list(F.struct("expansion", F.col("confidence").cast("double")))).alias("m"))
    return maps.select(*KEYS, F.explode(normalised_confidences("m")).alias("expansion", "c")).groupBy(*KEYS, "expansion").agg(F.sum("c").alias("confidence"))


#: The least confidence that counts, and the least ratio of the first to the second.
THRESHOLDS = {"svm": (0.25, None), "tfidf": (0.10, None), "document_context_vector": (0.15, None), "doc2vec": (0.5, 1.15), "sbert": (0.5, 1.15), "sci_dr": (None, None)}


def threshold_vote(scores: DataFrame, thresholds: dict = THRESHOLDS) -> DataFrame:
    """One vote of each expander whose best option is sure enough."""
    per = W.partitionBy("expander", *KEYS).orderBy(F.desc("confidence"), "expansion")
    r = scores.withColumn("rank", F.row_number().over(per)).withColumn("second", F.lead("confidence").over(per))
    ok = F.lit(False)
    for name, (least, ratio) in thresholds.items():
        own = F.lit(True) if least is None else F.col("confidence") >= least
        if ratio is not None:
            own = own & (F.coalesce(F.col("second"), F.lit(0.0)) * ratio <= F.col("confidence"))
        ok = ok | ((F.col("expander") == name) & own)
    vote = ((F.col("rank") == 1) & ok).cast("double")
    return r.withColumn("vote", vote).groupBy(*KEYS, "expansion").agg(F.sum("vote").alias("confidence"))


def trained_vote(scores: DataFrame, gold: DataFrame, rounds: int = 100):
    """Gradient boosting of stumps on the expanders' confidences: is this option the gold one? (model, scores)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    names = sorted(r[0] for r in scores.select("expander").distinct().collect())
    wide = scores.groupBy(*KEYS, "expansion").pivot("expander", names).agg(F.max("confidence")).fillna(0.0, names)
    train = wide.join(gold.select(*KEYS, F.col("expansion").alias("true")), KEYS).withColumn("label", (F.col("expansion") == F.col("true")).cast("double"))
    model = Pipeline(stages=[VectorAssembler(inputCols=names, outputCol="features"), GBTClassifier(maxIter=rounds, maxDepth=1, stepSize=1.0, seed=0)]).fit(train)
    out = model.transform(wide).select(*KEYS, "expansion", F.get(vector_to_array("probability"), F.lit(1)).alias("confidence"))
    return model, out


def span_scores(mentions: DataFrame, options: DataFrame, predict: Callable[[list[str], list[str]], list[str]], text_col: str = "raw_text") -> DataFrame:
    """Scores by a given model that writes an expansion for (acronym, text): the Jaccard similarity of its words with each option's."""
    from sparkronym.functions.similarity import jaccard

    @F.pandas_udf("string")
    def written(a: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series(predict(a.tolist(), t.tolist()))

    m = mentions.select(*KEYS, written("acronym", text_col).alias("span")).join(options, "acronym")
    return m.select(*KEYS, F.explode("options").alias("expansion"), "span").select(*KEYS, "expansion", jaccard("expansion", "span").alias("confidence"))


#: Extension surface: expanders by name.
REGISTRY: dict[str, Callable] = {
    "random": random_choice, "most_frequent": most_frequent, "cossim": cosine_scores, "cossim_dense": dense_cosine_scores, "cossim_term": term_cosine_scores, "uad_vote": vote_scores,
    "lr": logistic, "svm": svm, "rf": random_forest, "ensembler_hard": hard_vote, "ensembler_soft": soft_vote, "ensembler_threshold": threshold_vote, "ensembler_trained": trained_vote, "span": span_scores,
}
