"""Value-level checks: frequency, enums, cardinality, look-alike labels,
cross-field consistency, round numbers and encodings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from fieldgauge.functions.space import strip
from fieldgauge import fixed_values as fv
from fieldgauge.functions import bands
from fieldgauge.functions.text import col, has_non_latin, host, similarity, sorted_tokens
from fieldgauge.operators.scale import broadcast_if_small, scalar


def frequency_anomaly(df: DataFrame, column: str, share: float = 0.001) -> DataFrame:
    """Values of a should-be-unique column that hold more than ``share`` of all rows."""
    counts = df.groupBy(column).agg(F.count("*").alias("records"))
    total = scalar(counts.agg(F.sum("records")))
    return (counts.where(F.col(column).isNotNull() & (F.col("records") > total * F.lit(share)))
            .withColumn("pct", bands.pct("records", total)).orderBy(F.desc("records"), column))


def shared_domains(df: DataFrame, domain, min_keys: int = 50, key: str = "handle") -> DataFrame:
    """Domains found on at least ``min_keys`` distinct keys."""
    return (df.select(col(domain).alias("domain"), key).where("domain is not null and domain <> ''")
            .groupBy("domain").agg(F.count_distinct(key).alias("keys"), F.count("*").alias("records"))
            .where(F.col("keys") >= min_keys).orderBy(F.desc("records"), "domain"))


def enum_check(df: DataFrame, allowed: dict[str, Sequence[str]]) -> DataFrame:
    """Per enum column: rows outside the allowed set, nulls, distinct values seen."""
    cells = []
    for c, values in allowed.items():
        cells.append(F.struct(F.lit(c).alias("field"), F.count_if(~F.col(c).isin(*values)).alias("out_of_set"),
                              F.count_if(F.col(c).isNull()).alias("nulls")))
    return df.agg(F.array(*cells).alias("_c")).select(F.inline("_c"))


def cardinality_check(df: DataFrame, column: str, limit: int = 500, approximate: bool = False) -> DataFrame:
    d = F.approx_count_distinct(column, 0.01) if approximate else F.count_distinct(column)
    return df.agg(F.lit(column).alias("field"), d.alias("distinct_values")).withColumn(
        "within_limit", F.col("distinct_values") <= limit)


def distinct_labels(df: DataFrame, column: str) -> DataFrame:
    return df.select(F.lower(strip(column)).alias("label")).where("label <> ''").distinct()


HOT = 10_000   # postings of a piece or word beyond which its group is split


def _similar_keys(labels: DataFrame, threshold: float, hot: int) -> tuple[DataFrame, DataFrame]:
    """(short side, long side) of the join of similar labels, by key (n, start, piece, salt)."""
    eps, one = F.lit(1e-9), F.lit(1)
    form = labels.select("label", sorted_tokens("label").alias("form"))

    def cut(df: DataFrame, n: str) -> DataFrame:
        """Pieces (start, width) of a shorter form of length ``n`` and its distance e."""
        longest = F.floor(F.col(n) / F.lit(threshold) + eps)
        e = F.floor(longest * F.lit(1.0 - threshold) + eps).cast("int")
        wanted = F.greatest(F.col("e") + 2, F.least(2 * F.col("e") + 2, F.floor(F.col(n) / 2).cast("int")))
        return (df.withColumn("e", e).withColumn("count", wanted)
                .withColumn("i", F.explode(F.sequence(F.lit(0), F.col("count") - one)))
                .withColumn("start", F.floor(F.col(n) * F.col("i") / F.col("count")).cast("int"))
                .withColumn("width", F.floor(F.col(n) * (F.col("i") + one) / F.col("count")).cast("int") - F.col("start")))

    length = F.length("form")
    partner = form.withColumn("n", F.explode(F.sequence(F.ceil(length * F.lit(threshold) - eps).cast("int"), length)))
    at = F.sequence(F.greatest(F.col("start") - F.col("e"), F.lit(0)),
                    F.greatest(F.least(F.col("start") + F.col("e"), length - F.col("width")), F.lit(0)))
    key = ["n", "start", "piece"]
    long_ = (cut(partner, "n").where(F.col("start") - F.col("e") <= length - F.col("width"))
             .withColumn("piece", F.explode(F.array_distinct(
                 F.transform(at, lambda p: F.substring("form", p + one, F.col("width"))))))
             .select(F.col("label").alias("ll"), F.col("form").alias("lf"), *key))
    posted = long_.groupBy(*key).agg(F.count("*").alias("posts"))
    short = cut(form.withColumn("n", F.length("form")), "n").select(
        F.col("label").alias("sl"), F.col("form").alias("sf"), "n", "start", "e",
        F.substring("form", F.col("start") + one, F.col("width")).alias("piece"))
    rated = short.join(posted, key, "left").groupBy("sl", "sf", "n", "e").agg(
        F.array_sort(F.collect_list(F.struct(F.coalesce("posts", F.lit(0)).alias("posts"), "start", "piece"))).alias("pieces"))
    salts = F.greatest(F.ceil(F.col("posts") / hot), F.lit(1)).cast("int")
    short = (rated.withColumn("p", F.explode(F.slice("pieces", one, F.col("e") + one)))
             .select("sl", "sf", "n", "p.start", "p.piece", F.col("p.posts").alias("posts")).where("posts > 0")
             .withColumn("salt", F.explode(F.sequence(F.lit(0), salts - one))).drop("posts"))
    split = broadcast_if_small(posted.where(F.col("posts") > hot).select(*key, salts.alias("salts")))
    dealt = F.pmod(F.xxhash64("ll"), F.coalesce("salts", one)).cast("int")
    return short, long_.join(split, key, "left").withColumn("salt", dealt).drop("salts")


def similar_labels(labels: DataFrame, threshold: float = 0.85, hot: int = HOT) -> DataFrame:
    """Label pairs whose sorted-word forms are at least ``threshold`` alike.

    Alike means edit distance <= (1 - threshold) x the longer length. If e is
    the largest such distance for a shorter form of length n, cutting that form
    into e + m pieces leaves at least m intact inside any partner, shifted by at
    most e. So a form may leave out its m - 1 most frequent pieces: it publishes
    the e + 1 that fewest partners hold, and the substrings those could match
    meet them by equi join. m is e + 2 where pieces then have two characters or
    more, so a stem that many labels share may cover half of a label and brings
    none of them together. A piece that still has more than ``hot`` partners is
    split by salt. The exact measure is part of the join condition, so only true
    pairs leave it. Signatures per label depend on its length alone.
    """
    if not 0.5 < threshold <= 1.0:
        raise ValueError("threshold must be above 0.5 and at most 1")
    short, long_ = _similar_keys(labels, threshold, hot)
    s, l = short.alias("s"), long_.alias("l")
    same_key = ((F.col("s.n") == F.col("l.n")) & (F.col("s.start") == F.col("l.start"))
                & (F.col("s.piece") == F.col("l.piece")) & (F.col("s.salt") == F.col("l.salt")))
    ordered = (F.length("lf") > F.length("sf")) | (F.col("sl") < F.col("ll"))
    alike = similarity("sf", "lf") >= F.lit(threshold) - F.lit(1e-12)
    return (s.join(l, same_key & ordered & alike)
            .select(F.least("sl", "ll").alias("label_a"), F.greatest("sl", "ll").alias("label_b"),
                    similarity("sf", "lf").alias("score"))
            .distinct())


def _subset_keys(labels: DataFrame, hot: int) -> tuple[DataFrame, DataFrame]:
    """(short side, long side) of the join of subset labels, by key (first, second, salt)."""
    words = labels.select("label", F.array_distinct(F.split("label", r"\s+")).alias("words"))
    by_word = words.select("label", "words", F.explode("words").alias("word"))
    rarity = by_word.groupBy("word").agg(F.count("*").alias("n"))
    rated = by_word.join(rarity, "word")
    two = F.slice(F.array_sort(F.collect_list(F.struct("n", "word"))), 1, 2)
    salts = F.greatest(F.ceil(F.col("n") / hot), F.lit(1)).cast("int")
    is_hot = F.col("n") > hot
    pick = (rated.groupBy("label").agg(F.first("words").alias("short_words"), two.alias("w"))
            .select(F.col("label").alias("short_label"), "short_words", F.col("w")[0]["word"].alias("first"),
                    F.col("w")[0]["n"].alias("n"), F.get("w", F.lit(1))["word"].alias("next")))
    # the rarest word is the key; where that is hot, the next one goes with it; a lone hot word meets its labels in parts
    second = F.when(is_hot & F.col("next").isNotNull(), F.col("next")).otherwise("")
    short = (pick.withColumn("second", second)
             .withColumn("salt", F.explode(F.when(F.col("second") == "", F.sequence(F.lit(0), salts - 1)).otherwise(F.array(F.lit(0)))))
             .select("short_label", "short_words", "first", "second", "salt"))
    others = F.transform(F.array_remove("words", F.col("word")), lambda w: F.struct(w.alias("second"), F.lit(0).alias("salt")))
    lone = F.struct(F.lit("").alias("second"), F.pmod(F.xxhash64("label"), salts).cast("int").alias("salt"))
    long_ = (rated.withColumn("k", F.explode(F.when(is_hot, F.concat(F.array(lone), others)).otherwise(F.array(lone))))
             .select(F.col("label").alias("long_label"), F.col("words").alias("long_words"), F.col("word").alias("first"), "k.second", "k.salt"))
    return short, long_


def subset_labels(labels: DataFrame, hot: int = HOT) -> DataFrame:
    """Pairs where every word of the shorter label occurs in the longer one.

    The shorter label is keyed by its rarest word, which the longer label must
    contain; where more than ``hot`` labels hold that word, by its two rarest
    words, so labels meet only through one equi join and a word that all share
    brings together only what shares another one too."""
    short, long_ = _subset_keys(labels, hot)
    return (short.join(long_, ["first", "second", "salt"])
            .where((F.size("long_words") > F.size("short_words"))
                   & (F.size(F.array_except("short_words", "long_words")) == 0))
            .select("short_label", "long_label"))


def top_pairs(df: DataFrame, a: str = "city", b: str = "state", k: int = 20) -> DataFrame:
    return (df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b)
            .agg(F.count("*").alias("records")).orderBy(F.desc("records"), a, b).limit(k))


def implausible_size_report(df: DataFrame) -> DataFrame:
    top = F.count_if(F.col("size") == "10K+")
    hit = F.count_if(bands.implausible_size())
    return df.agg(hit.alias("implausible"), top.alias("largest_band"), bands.pct(hit, top).alias("pct_of_band"))


def type_suffix_check(df: DataFrame, types: Sequence[str] = ("Nonprofit", "Government Agency"),
                      suffixes: Sequence[str] = ("org", "gov", "mil", "edu")) -> DataFrame:
    """Per type: rows with an address, and those whose domain has another ending."""
    off = F.count_if(~host("website").rlike(rf"\.({'|'.join(suffixes)})$"))
    return (df.where(F.col("type").isin(*types) & F.col("website").isNotNull()).groupBy("type")
            .agg(off.alias("other_suffix"), F.count("*").alias("with_website"),
                 bands.pct(off, F.count("*")).alias("other_pct")))


def round_number_check(df: DataFrame, column: str = "founded", low: int = 1950, high: int = 2024) -> DataFrame:
    c = F.col(column)
    recent = c.between(low, high)
    n, m = F.count(c), F.count_if(recent)
    return df.agg(
        n.alias("non_null"), F.count_if(c % 1000 == 0).alias("mult_1000"),
        F.count_if((c % 100 == 0) & (c % 1000 != 0)).alias("mult_100"),
        m.alias("in_range"), F.count_if(recent & (c % 10 == 0)).alias("mult_10"),
        F.count_if(recent & (c % 5 == 0)).alias("mult_5"),
        bands.pct(F.count_if(c % 1000 == 0), n).alias("mult_1000_pct"),
        bands.pct(F.count_if(recent & (c % 10 == 0)), m).alias("mult_10_pct"),
        bands.pct(F.count_if(recent & (c % 5 == 0)), m).alias("mult_5_pct"))


def encoding_profile(df: DataFrame, column: str, special_share: float = 0.30, by: Sequence[str] = ()) -> DataFrame:
    """Counts of encoding artefacts over whole texts, optionally per group."""
    c = F.col(column)
    special = F.length(F.regexp_replace(c, "[a-zA-Z0-9 ]", ""))
    cjk, arabic, latin = c.rlike("[\\u4E00-\\u9FFF]"), c.rlike("[\\u0600-\\u06FF]"), c.rlike("[a-zA-Z]")
    return df.groupBy(*by).agg(
        F.count(c).alias("rows"),
        F.count_if(F.contains(c, F.lit("�"))).alias("replacement_char"),
        F.count_if(special > F.length(c) * F.lit(special_share)).alias("high_special_ratio"),
        F.count_if(cjk).alias("cjk"), F.count_if(arabic).alias("arabic"),
        F.count_if(cjk & latin).alias("latin_and_cjk"),
        F.count_if(c.rlike("[\\x{10000}-\\x{10FFFF}]")).alias("four_byte"),
        F.count_if(c.rlike("[^\\x00-\\x7F]")).alias("non_ascii"),
        F.count_if(has_non_latin(c)).alias("non_latin"))


def classify_invalid(raw: DataFrame, cleaned_state, state: str = "state") -> DataFrame:
    """Category, rows and distinct values of states that are set but not valid.
    ``cleaned_state`` is the normaliser's (value, flag) struct column."""
    flag = cleaned_state["flag"]
    s = strip(F.col(state))
    category = (F.when(s.isin(*fv.TERRITORIES) | s.isin("Virgin Islands", "Us Virgin Islands"), "territory")
                .when(flag == "state_case_fix", "case_mismatch")
                .when(flag == "state_city_recover", "city_leak")
                .when(flag == "state_abbrev_expand", "abbreviation")
                .when(flag == "state_redundant_prefix", "redundant_prefix")
                .when(flag == "state_typo_fix", "typo")
                .when(s.isin(*fv.FOREIGN_PLACES), "foreign")
                .when(s.isin(*fv.JUNK_STATES), "junk")
                .otherwise("unclassified"))
    off = raw.where(F.col(state).isNotNull()
                    & (~bands.valid_state(state) | F.col(state).isin(*fv.TERRITORIES)))
    return (off.select(category.alias("category"), F.col(state).alias("_v")).groupBy("category")
            .agg(F.count("*").alias("records"), F.count_distinct("_v").alias("distinct_values")))


def null_state_residue(df: DataFrame, sizes: Sequence[str] = fv.SIZE_BANDS[2:]) -> DataFrame:
    """Higher-value rows that have no state, per size band, beside the total without state."""
    gone = df.where(F.col("state").isNull())
    per = gone.groupBy("size").agg(F.count("*").alias("records"))
    return (per.where(F.col("size").isin(*sizes))
            .withColumn("total_null_state", scalar(per.agg(F.sum("records"))))
            .orderBy(F.desc("records"), "size"))
