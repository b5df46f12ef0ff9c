"""Extraction rules over tables and as SQL table functions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from sparkronym.operators import matchers
from sparkronym.shipping import ship

SCHEMA = "article_id string, acronym string, expansion string, error string"

#: Extension surface: rules by name; add one to use it in extract() and in SQL.
REGISTRY: dict[str, Callable[[str], dict]] = dict(matchers.RULES)


def _run(rule: Callable[[str], dict]):
    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows = []
            for article, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                try:
                    rows += [(article, a, e, None) for a, e in rule(text or "").items()]
                except Exception as e:  # noqa: BLE001 one bad text must not end the corpus: it is a row of its own
                    rows.append((article, None, None, f"{type(e).__name__}: {e}"))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], names=["article_id", "acronym", "expansion", "error"])

    return batches


def extract(articles: DataFrame, rule: str | Callable[[str], dict] = "schwartz_hearst", nulls: bool = False) -> DataFrame:
    """(article_id, acronym, expansion, error) of articles (article_id, raw_text).

    Texts go to Python in Arrow batches and are independent of each other: no shuffle.
    nulls: keep acronyms seen without an expansion. A text on which the rule fails
    gives one row with the error."""
    ship(articles.sparkSession)
    fn = REGISTRY[rule] if isinstance(rule, str) else rule
    out = articles.select(F.col("article_id").cast("string"), "raw_text").mapInArrow(_run(fn), SCHEMA)
    return out if nulls else out.where("expansion is not null or error is not null")


def register(spark: SparkSession) -> list[str]:
    """Every rule as a table function extract_<rule>(text) for SQL's LATERAL."""
    ship(spark)
    names = []
    for name, fn in REGISTRY.items():

        class Rule:
            _fn = staticmethod(fn)

            def eval(self, text: str):
                for a, e in self._fn(text or "").items():
                    yield a, e

        spark.udtf.register(f"extract_{name}", udtf(Rule, returnType="acronym string, expansion string"))
        names.append(f"extract_{name}")
    return names


def from_tags(rows: DataFrame) -> DataFrame:
    """Pairs of tagged token sequences (article_id, tokens, tags)."""
    ship(rows.sparkSession)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            got = [(i, a, e, None) for i, tok, tag in zip(*(part.column(k).to_pylist() for k in range(3)), strict=True) for a, e in matchers.pairs_from_tags(tok or [], tag or []).items()]
            cols = list(zip(*got, strict=True)) if got else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], names=["article_id", "acronym", "expansion", "error"])

    return rows.select(F.col("article_id").cast("string"), "tokens", "tags").mapInArrow(batches, SCHEMA)


def tagger_rule(tag: Callable[[list[str]], list[str]]) -> Callable[[str], dict]:
    """A rule from any sequence tagger (a pretrained network's, say): tokens -> BIO tags of short and long forms."""

    def run(text: str) -> dict:
        tokens = matchers.words_of(text)
        return matchers.pairs_from_tags(tokens, tag(tokens))

    return run


def majority_tagger(taggers: list[Callable[[list[str]], list[str]]]) -> Callable[[list[str]], list[str]]:
    """The tag that most taggers give each token; the first tagger's where they tie."""

    def run(tokens: list[str]) -> list[str]:
        votes = list(zip(*(t(tokens) for t in taggers), strict=True))
        return [max(v, key=lambda x: (v.count(x), -v.index(x))) for v in votes]

    return run
