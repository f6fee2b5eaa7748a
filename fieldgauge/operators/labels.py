"""Matching free text to a label taxonomy.

Texts are reduced to distinct values before anything is compared. The taxonomy
is a table of (label, pos[, sector, vector]) that stays partitioned: texts and
vectors meet it by equi joins or block by block.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from fieldgauge.functions.space import is_blank, strip
from fieldgauge import fixed_values as fv
from fieldgauge.functions.text import col, similarity
from fieldgauge.operators.blocks import in_blocks
from fieldgauge.operators.scale import broadcast_if_small
from fieldgauge.sources.workspace import materialise


def tidy(text: Column | str) -> Column:
    return F.nullif(strip(F.lower(col(text))), F.lit(""))


def words(text: Column | str) -> Column:
    """Distinct words of a text, stop words out."""
    w = F.array_distinct(F.split(col(text), r"[\s,&/\-]+"))
    return F.filter(w, lambda x: (x != "") & ~x.isin(*fv.LABEL_STOP_WORDS))


def label_words(label: Column | str) -> Column:
    w = F.array_distinct(F.split(col(label), r"[\s,&/]+"))
    return F.filter(w, lambda x: (x != "") & ~x.isin(*fv.LABEL_STOP_WORDS))


def snap_exact(texts: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """(text, label) where the text is a label, or the leading words of one; the
    exact label wins, then the first in taxonomy order. One equi join against a
    dictionary of labels and their leading word runs."""
    parts = F.split("label", " ")
    forms = F.transform(F.sequence(F.lit(1), F.size(parts)),
                        lambda i: F.array_join(F.slice(parts, F.lit(1), i), " "))
    spelled = labels.select("label", "pos", F.explode(forms).alias("_form"))
    rank = F.struct((F.col("_form") != F.col("label")), F.col("pos"))
    dictionary = spelled.groupBy("_form").agg(F.min_by("label", rank).alias("label"))
    return texts.select(text).join(dictionary, F.col(text) == F.col("_form")).select(text, "label")


def keyword_label(text: Column | str, rules: Sequence[tuple[Sequence[str], str]] = fv.KEYWORD_LABELS) -> Column:
    """Label of the first keyword rule that shares a word with the text."""
    mine = words(text)
    out = F
    for keys, label in rules:
        out = out.when(F.arrays_overlap(mine, F.array(*[F.lit(k) for k in keys])), F.lit(label))
    return out.otherwise(F.lit(None).cast("string"))


def _nearest_vectors(rows: DataFrame, labels: DataFrame, key: str, group: str) -> DataFrame:
    """(key, best): the label with the largest cosine among those of the row's group, first in order among equals. Each
    task multiplies a slice of rows by a block of labels; the best of the blocks is kept by key."""
    kind = rows.schema[key].dataType.simpleString()

    def compare(some, block):
        if not some.num_rows or not block.num_rows:
            return pa.table({key: some.column(key).slice(0, 0), "score": pa.array([], pa.float64()),
                             "order": pa.array([], pa.int64()), "label": pa.array([], pa.string())})
        def matrix(t):
            m = pa.concat_arrays(t.column("vector").chunks).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            m = m.reshape(t.num_rows, -1)
            return m / (np.linalg.norm(m, axis=1, keepdims=True) + 1e-9)
        place = block.column("pos").to_numpy()
        first = np.argsort(place, kind="stable")
        sims = np.nan_to_num(matrix(some) @ matrix(block)[first].T, nan=-2.0)
        best = sims.argmax(axis=1)
        return pa.table({key: some.column(key), "score": sims[np.arange(len(best)), best], "order": -place[first][best],
                         "label": block.column("label").take(pa.array(first[best]))})

    met = in_blocks(rows.select(key, "vector", group), labels.select("label", F.col("pos").cast("bigint").alias("pos"), "vector", group),
                    group, key, "label", compare, f"{key} {kind}, score double, order bigint, label string")
    return met.groupBy(key).agg(F.max(F.struct("score", "order", "label")).alias("best"))


def snap_cosine(rows: DataFrame, labels: DataFrame, key: str, at: float = 0.40) -> DataFrame:
    """Nearest label by cosine within the row's sector if that reaches ``at``, else over all labels if that does.
    ``rows`` has (key, sector, vector), its keys are unique. Rows meet the labels of their sector block by block; only
    those without an answer there go on to all blocks. The taxonomy stays partitioned."""
    have = rows.where("vector is not null").select(key, "sector", "vector")
    own = _nearest_vectors(have, labels, key, "sector").where(F.col("best.score") >= at)
    first = have.join(own.withColumnRenamed("best", "_own"), key, "left")
    whole = F.lit(0)
    far = _nearest_vectors(first.where("_own is null").withColumn("_all", whole), labels.withColumn("_all", whole), key, "_all")
    out = first.select(key, "_own").join(far.withColumnRenamed("best", "_far"), key, "left")
    best = F.coalesce("_own", "_far")
    hit = best["score"] >= at
    scope = F.when(F.col("_own").isNotNull(), "sector").when(hit, "all")
    return out.select(key, F.when(hit, best["label"]).alias("label"), scope.alias("scope"), best["score"].alias("score"))


def snap_overlap(texts: DataFrame, labels: DataFrame, text: str = "text", at: float = 0.35) -> DataFrame:
    """Best label by word overlap F1, a text word counting when it lies inside a label word. Every substring of every
    label word is a dictionary key that holds the list of its labels, so the containment test is an equi join of text
    words, at most one row each; the lists of a text are tallied within its row, and pairs of text and label never
    become rows."""
    lw = labels.select("label", "pos", label_words("label").alias("_lw")).where("size(_lw) > 0")
    pieces = lw.select("label", "pos", F.size("_lw").alias("_nl"), F.explode("_lw").alias("_w"))
    starts = F.sequence(F.lit(1), F.length("_w"))
    pieces = (pieces.withColumn("_s", F.explode(starts))
              .withColumn("_piece", F.explode(F.transform(
                  F.sequence(F.lit(1), F.length("_w") - F.col("_s") + 1),
                  lambda n: F.substring("_w", F.col("_s"), n))))
              .select("pos", "_nl", "_piece").distinct()
              .groupBy("_piece").agg(F.collect_list(F.struct("pos", "_nl")).alias("_posted")))
    mine = (texts.select(text, words(text).alias("_tw")).where("size(_tw) > 0")
            .select(text, F.size("_tw").alias("_nt"), F.explode("_tw").alias("_t")))
    met = (mine.join(pieces, F.col("_t") == F.col("_piece")).groupBy(text, "_nt")
           .agg(F.array_sort(F.flatten(F.collect_list("_posted"))).alias("_met")))

    def tally(a, x):
        """Hits of the label so far; the score grows with them, so the best of all steps is the best of all labels."""
        hits = F.when(a["pos"] == x["pos"], a["hits"] + 1).otherwise(F.lit(1))
        p, r = hits / F.col("_nt"), hits / x["_nl"]
        score = 2 * p * r / (p + r)
        return F.struct(x["pos"].alias("pos"), hits.alias("hits"),
                        F.greatest(a["best"], F.struct(score.alias("score"), (-x["pos"]).alias("order"))).alias("best"))

    kind = labels.schema["pos"].dataType
    nobody = F.struct(F.lit(None).cast(kind).alias("pos"), F.lit(0).alias("hits"),
                      F.struct(F.lit(0.0).alias("score"), F.lit(0).cast(kind).alias("order")).alias("best"))
    best = met.select(text, F.aggregate("_met", nobody, tally, lambda a: a["best"]).alias("_b")).where(F.col("_b.score") >= at)
    names = broadcast_if_small(labels.select("label", "pos"))
    return best.join(names, F.col("pos") == -F.col("_b.order")).select(text, "label", F.col("_b.score").alias("score"))


SEED_GRAMS = 4       # rarest pieces of a text that propose labels
SEED_LABELS = 64     # a piece of more labels proposes none; the block scan sees those labels all the same
GRAMS = (3, 5, 7)    # lengths of the pieces; where short ones are common, longer ones are rare
CHARS, PAIRS = 64, 256   # counters of characters and of neighbouring characters; shared ones only loosen a bound


def _grams(text: Column | str) -> Column:
    """Distinct pieces of the text, its ends marked."""
    c = F.concat(F.lit("^"), col(text), F.lit("$"))
    pieces = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - n + 1, F.lit(1))), lambda i: F.substring(c, i, F.lit(n)))
    return F.array_distinct(F.concat(*[pieces(n) for n in GRAMS]))


def edit_seeds(texts: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """(text, floor): similarity of the best label among those that share one of the text's rarest pieces, at most
    SEED_GRAMS * SEED_LABELS for each text. A lower bound of the best similarity, nothing else."""
    posted = (labels.select("label", F.explode(_grams("label")).alias("_g")).groupBy("_g")
              .agg(F.count("*").alias("_df"), F.collect_set("label").alias("_labels")).where(F.col("_df") <= SEED_LABELS))
    mine = texts.select(text, F.explode(_grams(text)).alias("_t"))
    met = mine.join(posted, F.col("_t") == F.col("_g")).groupBy(text).agg(
        F.slice(F.array_sort(F.collect_list(F.struct("_df", "_g", "_labels"))), 1, SEED_GRAMS).alias("_met"))
    proposed = F.array_distinct(F.flatten(F.col("_met._labels")))
    return met.select(text, F.array_max(F.transform(proposed, lambda l: similarity(F.col(text), l))).alias("floor"))


def _band(length: Column) -> Column:
    """Band of a length; about a sixth longer is a band further."""
    return F.floor(F.log1p(length) * 6).cast("int")


def _counted(codes: list[np.ndarray], size: int) -> np.ndarray:
    out = np.zeros((len(codes), size), np.int32)
    for i, c in enumerate(codes):
        np.add.at(out[i], c % size, 1)
    return out


def _edit_distances(text: np.ndarray, others: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Levenshtein distances of one text to rows of padded characters."""
    wide = others.shape[1]
    steps = np.arange(wide + 1)
    row = np.broadcast_to(steps, (len(others), wide + 1)).astype(np.int32)
    for i, c in enumerate(text, 1):
        new = np.empty_like(row)
        new[:, 0] = i
        new[:, 1:] = np.minimum(row[:, 1:] + 1, row[:, :-1] + (others != c))
        row = np.minimum.accumulate(new - steps, axis=1) + steps
    return row[np.arange(len(others)), lengths]


def _closest(name: str):
    """Best label of a block for each text of a slice. Labels are tried from the highest bound down, until no bound reaches
    the best similarity so far: an edit costs one character at most one place and two of the neighbouring pairs."""
    out = pa.schema([(name, pa.string()), ("score", pa.float64()), ("order", pa.int64()), ("label", pa.string()), ("tried", pa.int64())])

    def compare(some, block):
        labels, place = block.column("label").to_pylist(), block.column("pos").to_numpy()
        codes = [np.frombuffer(t.encode("utf-32-le"), np.uint32).astype(np.int64) for t in labels]
        lengths = np.array([len(c) for c in codes], np.int64)
        wide = np.full((len(codes), max(lengths, default=0)), -1, np.int64)
        for i, c in enumerate(codes):
            wide[i, :len(c)] = c
        pairs_of = lambda c: c[:-1] * 31 + c[1:]
        chars, pairs = _counted(codes, CHARS), _counted([pairs_of(c) for c in codes], PAIRS)
        rows = []
        for text, floor in zip(some.column(name).to_pylist(), some.column("floor").to_pylist()):
            mine = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
            longest = np.maximum(np.maximum(lengths, len(mine)), 1)
            least = longest - np.minimum(chars, _counted([mine], CHARS)).sum(1)
            bound = 1 - least / longest
            at = np.flatnonzero(bound >= floor)
            shared = np.minimum(pairs[at], _counted([pairs_of(mine)], PAIRS)).sum(1)
            least = np.maximum(least[at], -(-(longest[at] - 1 - shared) // 2))
            bound = 1 - least / longest[at]
            order = np.lexsort((place[at], -bound))
            at, bound = at[order], bound[order]
            best, tried, size = None, 0, 16
            while tried < len(at) and bound[tried] >= floor:
                part = at[tried:tried + size]
                score = 1 - _edit_distances(mine, wide[part], lengths[part]) / longest[part]
                top = max(zip(score.tolist(), (-place[part]).tolist(), part.tolist()))
                best = top if best is None else max(best, top)
                floor, tried, size = max(floor, best[0]), tried + len(part), min(4 * size, 1024)
            rows.append((text, *((best[0], best[1], labels[best[2]]) if best else (None, None, None)), tried))
        return pa.table([pa.array(c, t.type) for c, t in zip(list(zip(*rows)) or [()] * 5, out)], schema=out)
    return compare


def edit_candidates(texts: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """(text, score, order, label, tried): the best label of every block a text meets. A similarity of s bounds the
    ratio of the lengths by s, so a text meets only the length bands its floor leaves."""
    todo = texts.where(F.col(text).isNotNull()).select(text).distinct()
    floors = todo.join(edit_seeds(todo, labels, text), text, "left").withColumn("floor", F.coalesce("floor", F.lit(0.0)))
    most = labels.agg(F.max(F.length("label"))).first()[0] or 0
    n = F.length(text)
    # one character of slack on either side keeps rounding out of the bound
    low, high = F.greatest(F.floor(n * F.col("floor")) - 1, F.lit(0)), F.least(F.when(F.col("floor") > 0, F.ceil(n / F.col("floor")) + 1).otherwise(most), F.lit(most))
    low, high = _band(low), _band(F.greatest(high, F.lit(0)))
    floors = materialise(floors)     # one row per distinct text, read to count and to deal
    rows = (floors.withColumn("_low", low).withColumn("_high", high).where("_low <= _high")
            .select(text, "floor", F.explode(F.sequence("_low", "_high")).alias("_band")))
    known = labels.select("label", F.col("pos").cast("bigint").alias("pos"), _band(F.length("label")).alias("_band"))
    return in_blocks(rows, known, "_band", text, "label", _closest(text), f"{text} string, score double, order bigint, label string, tried bigint")


def snap_edit(texts: DataFrame, labels: DataFrame, text: str = "text", at: float = 0.45) -> DataFrame:
    """(text, label, score) of distinct texts: the closest label by edit similarity, first in order among equals, NULL
    where it stays below ``at``. Rare pieces propose labels whose similarity is a floor; the floor leaves few lengths,
    and within a block the bounds on shared characters and pairs, checked against the best so far, leave few labels to
    measure. The result is that of measuring all."""
    best = (edit_candidates(texts, labels, text).where("score is not null").groupBy(text)
            .agg(F.max(F.struct("score", "order", "label")).alias("_b")))
    return texts.select(text).distinct().join(best, text, "left").select(
        text, F.when(F.col("_b.score") >= at, F.col("_b.label")).alias("label"), F.col("_b.score").alias("score"))


def snap_cascade(texts: DataFrame, labels: DataFrame, rules: Sequence[tuple[Sequence[str], str]] = fv.KEYWORD_LABELS,
                 overlap_at: float = 0.35, edit_at: float = 0.45) -> DataFrame:
    """Distinct tidy texts -> (text, label, step): exact or leading words, keyword
    rules, word overlap, edit distance. Each step sees only what is left."""
    todo = texts.select(tidy("text").alias("text")).where("text is not null").distinct()
    usable = F.size(words("text")) > 0
    first = (todo.join(snap_exact(todo, labels).withColumnRenamed("label", "_exact"), "text", "left")
             .withColumn("_kw", F.when(F.col("_exact").isNull(), keyword_label("text", rules))))
    left = first.where(F.col("_exact").isNull() & F.col("_kw").isNull() & usable).select("text")
    overlap = snap_overlap(left, labels, at=overlap_at).select("text", F.col("label").alias("_overlap"))
    after = left.join(overlap, "text", "left")
    edit = snap_edit(after.where("_overlap is null").select("text"), labels, at=edit_at)
    late = after.join(edit.select("text", F.col("label").alias("_edit")), "text", "left")
    out = first.join(late, "text", "left")
    step = (F.when(F.col("_exact").isNotNull(), "exact").when(F.col("_kw").isNotNull(), "keyword")
            .when(F.col("_overlap").isNotNull(), "overlap").when(F.col("_edit").isNotNull(), "edit").otherwise("none"))
    return out.select("text", F.coalesce("_exact", "_kw", "_overlap", "_edit").alias("label"), step.alias("step"))


def snap_cascade_vectors(rows: DataFrame, labels: DataFrame, key: str, rules: Sequence[tuple[Sequence[str], str]] = fv.KEYWORD_LABELS,
                         cosine_at: float = 0.40) -> DataFrame:
    """(key, label, step) where vectors exist: exact or leading words, keyword rules, then the nearest label by cosine in
    the row's sector, else among all. ``rows`` has (key, text, sector, vector), ``labels`` (label, pos, sector, vector).
    Words are matched once per distinct text, vectors once per row that is left."""
    tidied = rows.select(key, tidy("text").alias("_text"), "sector", "vector")
    todo = tidied.select(F.col("_text").alias("text")).where("text is not null").distinct()
    first = (todo.join(snap_exact(todo, labels).withColumnRenamed("label", "_exact"), "text", "left")
             .withColumn("_kw", F.when(F.col("_exact").isNull(), keyword_label("text", rules)))
             .where("_exact is not null or _kw is not null"))
    known = tidied.join(first, F.col("_text") == F.col("text"), "left")
    left = known.where("_exact is null and _kw is null and _text is not null")
    near = snap_cosine(left, labels, key, cosine_at).select(F.col(key).alias("_k"), F.col("label").alias("_near"))
    out = known.select(key, "_exact", "_kw").join(near, F.col(key) == F.col("_k"), "left")
    step = (F.when(F.col("_exact").isNotNull(), "exact").when(F.col("_kw").isNotNull(), "keyword")
            .when(F.col("_near").isNotNull(), "cosine").otherwise("none"))
    return out.select(key, F.coalesce("_exact", "_kw", "_near").alias("label"), step.alias("step"))


def snap_method(inferred: Column, confirmed: Column, snapped: Column, sector: Column, original: Column) -> Column:
    """(label, method) of one row: a confirmed rule label, the snapped label, the
    original one, or none."""
    def pick(label, method):
        return F.struct(label.alias("label"), F.lit(method).alias("method"))

    return (F.when(inferred.isNotNull() & confirmed, pick(inferred, "stage0_tld"))
            .when(snapped.isNotNull() & sector.isNotNull(), pick(snapped, "embeddings"))
            .when(snapped.isNotNull(), pick(snapped, "keyword"))
            .when(~is_blank(original), pick(original, "passthrough"))
            .otherwise(pick(F.lit(None).cast("string"), "none")))


def matching_share(a: str, b: str) -> float:
    """``SequenceMatcher(None, a, b).ratio()``: the longest block both hold, earliest in ``a`` and then in ``b``, and the
    same to its left and right. From 200 characters of ``b`` on its rule for frequent characters holds."""
    if len(b) >= 200:
        from difflib import SequenceMatcher

        return SequenceMatcher(None, a, b).ratio()
    met, parts = 0, [(a, b)]
    while parts:
        x, y = parts.pop()
        size = start = at = 0
        for i in range(len(x)):
            # a block from here counts only if it is longer than the best one
            while i + size < len(x) and (j := y.find(x[i:i + size + 1])) >= 0:
                size, start, at = size + 1, i, j
        if size:
            met += size
            parts += [(x[:start], y[:at]), (x[start + size:], y[at + size:])]
    return 2.0 * met / (len(a) + len(b)) if a or b else 1.0


@F.pandas_udf(T.DoubleType())
def _matching_share(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the characters in the matching blocks over all characters, once for each distinct pair of a batch. Rows
    without both texts, nearly all of a batch, are left alone."""
    out, shares = np.full(len(a), np.nan), {}
    rows = np.flatnonzero((a.notna() & b.notna()).to_numpy())
    for row, pair in zip(rows, zip(a.to_numpy()[rows], b.to_numpy()[rows])):
        if pair not in shares:
            shares[pair] = matching_share(*pair)
        out[row] = shares[pair]
    return pd.Series(out)


def sequence_ratio(a: Column | str, b: Column | str) -> Column:
    """2 M / T: M characters in the longest matching block and, recursively, the blocks to its left and right, T those of
    both texts; two empty texts give 1. Pairs where one is the start of the other, or nothing can match, are settled by
    built-in functions, and only the others reach Python."""
    a, b = col(a), col(b)
    total = F.length(a) + F.length(b)
    shorter = F.least(F.length(a), F.length(b))
    easy = a.startswith(b) | b.startswith(a)
    hard = F.when(~easy, a), F.when(~easy, b)
    return (F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when(total == 0, F.lit(1.0))
            .when(easy, F.lit(2.0) * shorter / total).otherwise(_matching_share(*hard)))


def names_far(a: Column | str, b: Column | str, below: float) -> Column:
    """Is it plain, without comparing, that two lower-case names share less than ``below`` of their characters? Their
    lengths may rule it out, or their letters: a name matches no more characters than it has of those the other holds."""
    a, b = col(a), col(b)
    total = F.nullif(F.length(a) + F.length(b), F.lit(0))

    def met(x: Column, y: Column) -> Column:
        return F.length(x) - F.length(F.call_function("translate", x, y, F.lit("")))

    lengths = F.lit(2.0) * F.least(F.length(a), F.length(b)) / total
    letters = F.lit(2.0) * F.least(met(a, b), met(b, a)) / total
    return F.coalesce((lengths < below) | (letters < below), F.lit(False))


def name_diverges(name: Column | str, other: Column | str, below: float = 0.70) -> Column:
    """Do two names share less than ``below`` of their characters?"""
    a, b = F.lower(F.coalesce(col(name), F.lit(""))), F.lower(col(other))
    far = names_far(a, b, below)
    return far | (sequence_ratio(F.when(~far, a), F.when(~far, b)) < below)


def with_divergence(df: DataFrame, name: str, other: str, flag: str, below: float = 0.70) -> DataFrame:
    """``name_diverges`` as a column, worked out in steps so that each part is computed once per row."""
    low = df.withColumns({"_a": F.lower(F.coalesce(name, F.lit(""))), "_b": F.lower(other)})
    far = low.withColumn("_far", names_far("_a", "_b", below))
    near = far.withColumns({"_a": F.when(~F.col("_far"), F.col("_a")), "_b": F.when(~F.col("_far"), F.col("_b"))})
    return near.withColumn(flag, F.col("_far") | (sequence_ratio("_a", "_b") < below)).drop("_a", "_b", "_far")
