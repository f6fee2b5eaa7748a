"""Toxicity by a classifier chain.

Categories are predicted in order; each later linear model also reads the log-odds of the earlier categories, and is
trained on out-of-fold predictions of those. Features are the presence of words, word beginnings and runs of signs. Each category
takes the words whose presence says most about it (G-squared over document counts), chosen without the fold held out.

The models are fitted on at most ``max_labelled`` labelled documents, those whose id has the least hash; that bound and
``words`` also bound what reaches the driver. Every document is scored over its whole text.

Defined results: null text is an empty text; labels with a null id or a null category are left out, a repeated id takes
its largest label; a repeated document is scored as often as it comes, and the least text of an id is learnt from;
without labels probabilities are null and nothing is toxic; no rows give no rows; other columns, whatever their names,
are never looked at.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fieldgauge.llm.common import apart, query, table, texts_of
from fieldgauge.sources.workspace import materialise

CATEGORIES = ("quality", "toxic")
MAX_LABELLED = 20_000
FOLDS = 3
WORDS = 200
LEAST_DOCS = 5
RIDGE = 0.3

_TOKEN = re.compile(r"[^\W\d_]+|[^\w\s]+")


PREFIXES = (3, 5, 7)


def words_of(text: str) -> set[str]:
    """Words, runs of signs, and the beginnings of longer words, which stand for their inflected forms."""
    whole = set(_TOKEN.findall(text.lower()))
    return whole.union(*({w[:n] + "*" for w in whole if len(w) > n} for n in PREFIXES))


def fit_linear(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE, rounds: int = 25) -> np.ndarray:
    """Logistic weights by Newton's method; the last column of ``x`` is the intercept and hardly held back."""
    hold = np.full(x.shape[1], ridge)
    hold[-1] = 1e-3
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(hold), x.T @ (p - y) + hold * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


@dataclass
class Chain:
    """Per category: word weights, weights of earlier log-odds, intercept."""
    categories: tuple[str, ...]
    words: list[dict[str, float]]
    earlier: list[list[float]]
    intercept: list[float]

    def odds(self, present: set[str]) -> list[float]:
        out: list[float] = []
        for words, earlier, start in zip(self.words, self.earlier, self.intercept):
            z = start + sum(words[w] for w in present & words.keys()) + sum(a * b for a, b in zip(earlier, out))
            out.append(min(30.0, max(-30.0, z)))
        return out


def _word_counts(categories: int, folds: int):
    """Documents per word: by fold, then by category and fold those with the label."""
    width = folds * (1 + categories)

    def run(batches):
        for batch in batches:
            fold = batch.column(batch.schema.get_field_index("fold")).to_pylist()
            ys = [batch.column(batch.schema.get_field_index(f"y{c}")).to_pylist() for c in range(categories)]
            counts: dict[str, np.ndarray] = {}
            for i, raw in enumerate(texts_of(batch)):
                at = [fold[i]] + [folds * (1 + c) + fold[i] for c in range(categories) if ys[c][i]]
                for w in words_of(raw.decode()) | {""}:  # "" counts the documents
                    row = counts.get(w)
                    if row is None:
                        row = counts[w] = np.zeros(width, np.int64)
                    row[at] += 1
            if counts:
                grid = np.stack(list(counts.values()))
                yield pa.RecordBatch.from_arrays([pa.array(list(counts)), *[pa.array(grid[:, k]) for k in range(width)]],
                                                 names=["word", *[f"c{k}" for k in range(width)]])
    return run, "word string, " + ", ".join(f"c{k} bigint" for k in range(width))


def _present(vocabulary: dict[str, int], categories: int):
    def run(batches):
        known = vocabulary.keys()
        for batch in batches:
            idx = [[vocabulary[w] for w in words_of(raw.decode()) & known] for raw in texts_of(batch)]
            cols = [batch.column(batch.schema.get_field_index(c)) for c in ("fold", *[f"y{c}" for c in range(categories)])]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(idx, pa.list_(pa.int32()))], names=["fold", *[f"y{c}" for c in range(categories)], "idx"])
    return run, "fold int, " + ", ".join(f"y{c} int" for c in range(categories)) + ", idx array<int>"


def fit_chain(docs: DataFrame, labels: DataFrame, categories=CATEGORIES, max_labelled: int = MAX_LABELLED, folds: int = FOLDS, words: int = WORDS) -> Chain | None:
    each = [F.max(F.col(c).cast("int")).alias(f"y{i}") for i, c in enumerate(categories)]
    known = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_id")).agg(*each).dropna()
    mixed = F.xxhash64("_id")
    sample = known.orderBy(mixed, "_id").limit(max_labelled).withColumn("fold", F.pmod(F.xxhash64("_id", F.lit("fold")), F.lit(folds)).cast("int"))
    n = len(categories)
    # one text for each id, so repeated ids can't outgrow the bound; written once, as it is read twice
    train = materialise(docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("_id"))
                        .groupBy("_id", "fold", *[f"y{c}" for c in range(n)]).agg(F.min("text").alias("text"))
                        .select("text", "fold", *[f"y{c}" for c in range(n)]))
    run, ddl = _word_counts(n, folds)
    width = folds * (1 + n)
    sums = train.mapInArrow(run, ddl).groupBy("word").agg(*[F.sum(f"c{k}").alias(f"c{k}") for k in range(width)])
    counts = materialise(sums.where(sum(F.col(f"c{k}") for k in range(folds)) >= LEAST_DOCS))
    whole = counts.where("word = ''").first()
    if whole is None:
        return None

    def best(category: int, out: int | None) -> list[str]:
        """The words that say most about a category, with one fold left out."""
        use = [f for f in range(folds) if f != out]
        a = sum(F.col(f"c{folds * (1 + category) + f}") for f in use).cast("double")
        b = sum(F.col(f"c{f}") for f in use).cast("double") - a
        pos = float(sum(whole[f"c{folds * (1 + category) + f}"] for f in use))
        neg = float(sum(whole[f"c{f}"] for f in use)) - pos

        def part(x, row, col):
            return F.when(x > 0, x * F.log(x * (pos + neg) / (row * col))).otherwise(0.0)
        g = (part(a, a + b, F.lit(pos)) + part(b, a + b, F.lit(neg))
             + part(pos - a, pos + neg - a - b, F.lit(pos)) + part(neg - b, pos + neg - a - b, F.lit(neg)))
        top = counts.where("word <> ''").select("word", g.alias("g")).orderBy(F.desc("g"), "word").limit(words)
        return [r["word"] for r in top.collect()]  # at most ``words``

    chosen = {(c, f): best(c, f) for c in range(n) for f in [*range(folds), None]}
    vocabulary = {w: i for i, w in enumerate(sorted({w for ws in chosen.values() for w in ws}))}
    run, ddl = _present(vocabulary, n)
    rows = train.mapInArrow(run, ddl).collect()  # at most max_labelled documents, as word numbers
    fold = np.array([r["fold"] for r in rows])
    grid = np.zeros((len(rows), len(vocabulary)), np.float32)
    for i, r in enumerate(rows):
        grid[i, r["idx"]] = 1
    chain = Chain(tuple(categories), [], [], [])
    odds = np.zeros((len(rows), 0))
    for c in range(n):
        y = np.array([r[f"y{c}"] for r in rows], float)

        def matrix(f, at):
            return np.column_stack([grid[at][:, [vocabulary[w] for w in chosen[c, f]]], odds[at], np.ones(len(at))]).astype(float)
        held = np.zeros(len(rows))
        for f in range(folds):
            here, there = np.flatnonzero(fold == f), np.flatnonzero(fold != f)
            if len(here) and len(there):
                held[here] = matrix(f, here) @ fit_linear(matrix(f, there), y[there])
        w = fit_linear(matrix(None, np.arange(len(rows))), y)
        k = len(chosen[c, None])
        chain.words.append(dict(zip(chosen[c, None], w[:k].tolist())))
        chain.earlier.append(w[k:-1].tolist())
        chain.intercept.append(float(w[-1]))
        odds = np.column_stack([odds, np.clip(held, -30, 30)])
    return chain


def scored(docs: DataFrame, chain: Chain | None, threshold: float = 0.5) -> DataFrame:
    """``docs`` with ``_p``, a struct of one probability per category, and ``_toxic``."""
    ddl = "struct<" + ",".join(f"{c}:double" for c in (chain.categories if chain else CATEGORIES)) + ">"
    if chain is None:
        return docs.withColumn("_p", F.lit(None).cast(ddl)).withColumn("_toxic", F.lit(False))

    @F.pandas_udf(ddl)
    def score(text: pd.Series) -> pd.DataFrame:
        odds = np.array([chain.odds(words_of(t or "")) for t in text]).reshape(len(text), -1)
        return pd.DataFrame(1 / (1 + np.exp(-odds)), columns=list(chain.categories))
    return docs.withColumn("_p", score(F.coalesce("text", F.lit("")))).withColumn("_toxic", F.col("_p")[chain.categories[-1]] >= threshold)


def clean_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not toxic, columns unchanged."""
    held, back = apart(docs, "doc_id", "text")
    return back(scored(held, fit_chain(docs, labels)).where(~F.col("_toxic")))


@query("op4_toxicity_chain")
def op4_toxicity_chain(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = scored(docs, fit_chain(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", F.col("_p.quality").alias("p_quality"), F.col("_p.toxic").alias("p_toxic"), F.col("_toxic").alias("toxic"))
