"""Choosing expansions by graph convolution over a text's words.

A text is a graph: its words, in order, each joined to the next and to the word's own next
occurrence, so that what is said far apart about one word is near. Two convolutions mix
what neighbours hold; the mean over all words meets a vector for each option of the
acronym.

Acronyms are dealt into chunks by hash, and each chunk has a model of its own, so that a
worker holds the words and options of one chunk. Rows and models meet by (chunk, part):
a chunk of many rows is fitted in parts from the same start, and their models are
averaged by rows, round after round. Models are rows of a table throughout; neither they
nor the texts come to the driver.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sparkronym.shipping import ship
from sparkronym.storage import Steps

KEYS = ["article_id", "acronym"]
#: Rows of hashed words, numbers of a word's vector and of a state, and texts in a step.
WORDS, WIDTH, BATCH, RATE = 1 << 12, 24, 64, 0.01
PARTS = ("words", "w1", "b1", "w2", "b2", "options", "prior")


def start(options: int, seed: int = 0) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    normal = lambda *shape, scale: r.normal(0, scale, shape)
    out = {"words": normal(WORDS, WIDTH, scale=0.3), "w1": normal(WIDTH, WIDTH, scale=0.3), "b1": np.zeros(WIDTH), "w2": normal(WIDTH, WIDTH, scale=0.3), "b2": np.zeros(WIDTH)}
    return out | {"options": np.random.default_rng([seed, 1]).normal(0, 0.3, (options, WIDTH)), "prior": np.zeros(options)}


def pack(p: dict[str, np.ndarray]) -> bytes:
    return b"".join(p[k].astype(np.float32).tobytes() for k in PARTS)


def unpack(data: bytes) -> dict[str, np.ndarray]:
    flat = np.frombuffer(data, np.float32).astype(float)
    fixed = [WORDS * WIDTH, WIDTH * WIDTH, WIDTH, WIDTH * WIDTH, WIDTH]
    options = (len(flat) - sum(fixed)) // (WIDTH + 1)
    cuts = np.split(flat, np.cumsum([*fixed, options * WIDTH]))
    return {k: x.reshape(-1, WIDTH) if k in ("words", "w1", "w2", "options") else x for k, x in zip(PARTS, cuts, strict=True)}


class Graphs:
    """Texts' words and edges, one text after the other, and the options of each."""

    def __init__(self, texts: Sequence[Sequence[str]], options: Sequence[Sequence[int]]):
        n = np.array([len(t) for t in texts], np.int64)
        self.n, self.of = len(texts), np.repeat(np.arange(len(texts)), n)
        self.size = np.maximum(1, n)
        self.word = np.array([zlib.crc32(w.encode()) % WORDS for t in texts for w in t], np.int64)
        edges = set()
        for at, t in zip((np.cumsum(n) - n).tolist(), texts, strict=True):
            last: dict[str, int] = {}
            for k, w in enumerate(t, at):
                if k > at:
                    edges.add((k - 1, k))
                if w in last:
                    edges.add((last[w], k))
                last[w] = k
        e = np.array(sorted(edges), np.int64).reshape(-1, 2)
        own = np.arange(len(self.word))
        self.a, self.b = np.concatenate((e[:, 0], e[:, 1], own)), np.concatenate((e[:, 1], e[:, 0], own))
        degree = np.bincount(self.b, minlength=len(own))
        self.weight = 1 / np.sqrt(degree[self.a] * degree[self.b])
        self.per = np.array([len(o) for o in options], np.int64)
        self.option = np.array([x for o in options for x in o], np.int64)
        self.asked = np.repeat(np.arange(len(options)), self.per)

    def mixed(self, x: np.ndarray) -> np.ndarray:
        """What each word's neighbours and itself hold, by their degrees; its own transpose."""
        out = np.zeros_like(x)
        np.add.at(out, self.b, self.weight[:, None] * x[self.a])
        return out


def _shares(g: Graphs, score: np.ndarray) -> np.ndarray:
    """Softmax over the options of each text."""
    top = np.full(g.n, -np.inf)
    np.maximum.at(top, g.asked, score)
    e = np.exp(score - top[g.asked])
    return e / np.bincount(g.asked, e, g.n)[g.asked]


def forward(p: dict, g: Graphs) -> tuple[np.ndarray, tuple]:
    """The share of each option, text by text."""
    x0 = g.mixed(p["words"][g.word])
    z1 = x0 @ p["w1"] + p["b1"]
    x1 = g.mixed(np.maximum(z1, 0))
    z2 = x1 @ p["w2"] + p["b2"]
    pooled = np.zeros((g.n, WIDTH))
    np.add.at(pooled, g.of, np.maximum(z2, 0))
    pooled /= g.size[:, None]
    return _shares(g, (pooled[g.asked] * p["options"][g.option]).sum(1) + p["prior"][g.option]), (x0, z1, x1, z2, pooled)


def loss_and_gradient(p: dict, g: Graphs, right: np.ndarray) -> tuple[float, dict]:
    """Mean negative log share of the right option (a 1 for each text among its options), and its gradients."""
    share, (x0, z1, x1, z2, pooled) = forward(p, g)
    loss = -np.log(np.maximum(share[right == 1], 1e-300)).sum() / g.n
    d = (share - right) / g.n
    out = {k: np.zeros_like(v) for k, v in p.items()}
    np.add.at(out["prior"], g.option, d)
    np.add.at(out["options"], g.option, d[:, None] * pooled[g.asked])
    d_pool = np.zeros_like(pooled)
    np.add.at(d_pool, g.asked, d[:, None] * p["options"][g.option])
    d2 = (d_pool / g.size[:, None])[g.of] * (z2 > 0)
    out["w2"], out["b2"] = x1.T @ d2, d2.sum(0)
    d1 = g.mixed(d2 @ p["w2"].T) * (z1 > 0)
    out["w1"], out["b1"] = x0.T @ d1, d1.sum(0)
    np.add.at(out["words"], g.word, g.mixed(d1 @ p["w1"].T))
    return loss, out


def _fit_part(epochs: int, seed: int):
    """A chunk's model after epochs over one part of its rows (Adam), with the number of rows."""

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table, model: pa.Table) -> pa.Table:
        chunk = key[0].as_py()
        if not len(model):
            return pa.table({"chunk": pa.array([], pa.int32()), "n": pa.array([], pa.int64()), "model": pa.array([], pa.binary())})
        p = unpack(model.column("model")[0].as_py())
        if len(rows):
            rows = rows.sort_by([("article_id", "ascending"), ("label", "ascending")])
            texts, options, label = (rows.column(c).to_pylist() for c in ("tokens", "options", "label"))
            rng = np.random.default_rng([seed, chunk, key[1].as_py()])
            momentum, step = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in p.items()}, 0
            for _ in range(epochs):
                for at in np.array_split(rng.permutation(len(texts)), max(1, len(texts) // BATCH)):
                    g = Graphs([texts[k] or [] for k in at], [options[k] for k in at])
                    right = (g.option == np.array([label[k] for k in at])[g.asked]).astype(float)
                    _, grad = loss_and_gradient(p, g, right)
                    step += 1
                    for k, m in momentum.items():
                        m[0] += 0.1 * (grad[k] - m[0])
                        m[1] += 0.001 * (grad[k] ** 2 - m[1])
                        p[k] = p[k] - RATE * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.999**step)) + 1e-8)
        return pa.table({"chunk": pa.array([chunk], pa.int32()), "n": pa.array([len(rows)], pa.int64()), "model": pa.array([pack(p)], pa.binary())})

    return run


def _average(table: pa.Table) -> pa.Table:
    n = np.asarray(table.column("n")).astype(float)
    total = sum(x * np.frombuffer(m.as_py(), np.float32) for x, m in zip(n, table.column("model"), strict=True)) / max(1.0, n.sum())
    return pa.table({"chunk": table.column("chunk").slice(0, 1), "model": pa.array([total.astype(np.float32).tobytes()], pa.binary())})


def _predict(rows: pa.Table, model: pa.Table) -> pa.Table:
    out: dict = {"acronym": [], "same": [], "label": [], "confidence": []}
    if len(rows) and len(model):
        p = unpack(model.column("model")[0].as_py())
        for a in range(0, len(rows), 512):
            part = rows.slice(a, 512)
            options = part.column("options").to_pylist()
            g = Graphs([t or [] for t in part.column("tokens").to_pylist()], options)
            out["confidence"] += forward(p, g)[0].tolist()
            out["label"] += g.option.tolist()
            for c in ("acronym", "same"):
                out[c] += np.repeat(np.array(part.column(c).to_pylist(), object), g.per).tolist()
    return pa.table({c: pa.array(v, t) for (c, v), t in zip(out.items(), (pa.string(), pa.string(), pa.int32(), pa.float64()), strict=True)})


def graph_scores(
    mentions: DataFrame, dictionary: DataFrame, test_tokens: DataFrame, train_tokens: DataFrame, chunks: int = 8, rounds: int = 3, epochs: int = 10, part: int = 20_000, seed: int = 0
) -> DataFrame:
    """(article_id, acronym, expansion, confidence): the share that the acronym's chunk's model gives each option.

    Tokens are tables (article_id, tokens). Mentions of an acronym with the same words are one row of the model's work.
    A mention without words gets the options' shares without any. Options that no training article with tokens shows
    keep their start. More rows than `part` of a chunk are fitted in parts, whose models are averaged after each round."""
    spark = mentions.sparkSession
    ship(spark)
    steps = Steps(spark, "graphs")
    chunk = F.pmod(F.xxhash64(F.lit(seed), "acronym"), F.lit(chunks)).cast("int")
    labels = dictionary.select("acronym", "expansion").distinct().withColumn("chunk", chunk)
    labels = steps.cut(labels.withColumn("label", (F.row_number().over(W.partitionBy("chunk").orderBy("acronym", "expansion")) - 1).cast("int")))
    options = labels.groupBy("acronym", "chunk").agg(F.sort_array(F.collect_list("label")).alias("options"))

    def dealt(df: DataFrame, *by: str) -> DataFrame:
        """With the part of its chunk that a row is in."""
        n = df.groupBy("chunk").agg(F.ceil(F.count("*") / part).cast("int").alias("parts"))
        return steps.cut(df.join(n, "chunk").withColumn("part", F.pmod(F.xxhash64(*by), F.col("parts")).cast("int")))

    train = dictionary.select("acronym", "expansion", "article_id").distinct().join(labels, ["acronym", "expansion"]).join(train_tokens.select("article_id", "tokens"), "article_id")
    train = dealt(train.join(options.drop("chunk"), "acronym").select("chunk", F.col("article_id").cast("string").alias("article_id"), "label", "options", "tokens"), "article_id", "label")
    sizes = labels.groupBy("chunk").agg(F.count("*").cast("int").alias("n"))

    first = F.udf(lambda n: pack(start(n, seed)), "binary")

    model = steps.cut(sizes.select("chunk", first("n").alias("model")))
    parts = steps.cut(train.select("chunk", "part").distinct())
    grid = ["chunk", "part"]
    for k in range(rounds):
        own = train.groupBy(*grid).cogroup(model.join(parts, "chunk").select(*grid, "model").groupBy(*grid))
        fitted = own.applyInArrow(_fit_part(epochs, seed * 1000 + k), "chunk int, n long, model binary").groupBy("chunk").applyInArrow(_average, "chunk int, model binary")
        new = steps.cut(fitted.unionByName(model.join(parts, "chunk", "left_anti")))  # chunks without training texts keep their start
        steps.drop(model)
        model = new

    tokens = test_tokens.select("article_id", "tokens")
    tests = mentions.select(*KEYS).distinct().join(tokens, "article_id", "left").withColumn("same", F.sha2(F.coalesce(F.to_json("tokens"), F.lit("")), 256))
    tests = steps.cut(tests.join(options, "acronym"))
    folded = dealt(tests.groupBy("chunk", "acronym", "same").agg(F.first("tokens").alias("tokens"), F.first("options").alias("options")), "acronym", "same")
    spread = model.join(steps.cut(folded.select("chunk", "part").distinct()), "chunk").select(*grid, "model")
    scored = folded.groupBy(*grid).cogroup(spread.groupBy(*grid)).applyInArrow(_predict, "acronym string, same string, label int, confidence double")
    named = scored.join(labels.select("acronym", "expansion", "label"), ["acronym", "label"])
    return tests.select(*KEYS, "same").join(named, ["acronym", "same"]).select(*KEYS, "expansion", "confidence")
