"""Personal data by bootstrapped contextual extraction, in DataFrame functions throughout.

Plain patterns find e-mail addresses, IP addresses, card and phone numbers. These are the seeds. The two words before a
seed are a lexical pattern; tokens with digits that follow the same words elsewhere are instances. Patterns and
instances form a graph that is scored in turns: a pattern is worth the mean worth of its distinct instances, an instance
that is no seed the worth of its best patterns. A pattern counts only with MIN_SUPPORT worthy instances, and only if an
identifier follows its two words at most of their places in the corpus, which keeps ordinary words from turning into
patterns. Patterns come in generations: instances of patterns of at least MIN_WORTH keep their worth and support further
patterns as seeds do, until a generation adds no pattern. Tokens found by patterns of at least MIN_WORTH are reported as
kind ``context``.

Defined results: null text is empty and has no span; a repeated row is scanned as often as it comes; a null doc_id is an
ordinary value; no rows give no rows; other columns are never looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fieldgauge.llm.common import query, table
from fieldgauge.sources.workspace import materialise

KINDS = ("email", "ip", "card", "phone")
MIN_SUPPORT = 5
MIN_WORTH = 0.8
ROUNDS = 3

# The plain patterns. A guard at the start and possessive runs keep long runs of one class linear; the matches are those
# of the patterns without them, since a match can start only where its first run starts or where the last match ended.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9]++(?:[\x20-][0-9]++)*+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
TOKEN = r"(?:\G|(?<![^\x20\x09-\x0D]))(?=[^\x20\x09-\x0D0-9]*+[0-9])[^\x20\x09-\x0D]++"
# Two words before the end of a text, and what of a text the words before its next match can come from: its last two
# whole words and the begun one. Both start at a word, so long words are read once.
BEFORE = r"(?<![^\x20\x09-\x0D])([^\x20\x09-\x0D]++[\x20\x09-\x0D]++[^\x20\x09-\x0D]++)[\x20\x09-\x0D]++$"
LAST = r"(?<![^\x20\x09-\x0D])(?:[^\x20\x09-\x0D]++[\x20\x09-\x0D]++){0,2}[^\x20\x09-\x0D]*+$"
_ONE = "struct<start:bigint,end:bigint,m:string,before:string>"
_SPAN = f"array<{_ONE}>"
CHUNK = 128


def walk(items: Column, start: dict[str, Column], step, kind: str) -> Column:
    """One pass over an array with named state: ``step(state, item)`` gives the new state and an element of ``kind`` to put
    out, or null. What a piece of CHUNK items puts out is gathered before it joins the rest, since an array is copied for
    each element appended; so the cost stays in proportion to the items."""
    def piece(state, chunk):
        def one(a, z):
            new, out = step(a, z)
            return F.struct(*[new[k].alias(k) for k in start], F.when(out.isNull(), a["out"]).otherwise(F.array_append(a["out"], out)).alias("out"))
        return F.aggregate(chunk, F.struct(*[state[k].alias(k) for k in start], F.array().cast(f"array<{kind}>").alias("out")), one)

    def join(a, chunk):
        joined = F.transform(F.array(piece(a, chunk)), lambda r: F.struct(*[r[k].alias(k) for k in start], F.array_append(a["outs"], r["out"]).alias("outs")))
        return F.get(joined, F.lit(0))
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / CHUNK).cast("int")), lambda i: F.slice(items, i * CHUNK + 1, F.lit(CHUNK)))
    first = F.struct(*[v.alias(k) for k, v in start.items()], F.array().cast(f"array<array<{kind}>>").alias("outs"))
    done = F.aggregate(chunks, first, join, lambda a: F.flatten(a["outs"]))
    return F.when(F.size(items) > 0, done).otherwise(F.array().cast(f"array<{kind}>"))


def spans(text: Column, matches: Column, pattern: str) -> Column:
    """Start, end (code points), match and the two words of the text before, of each match. ``matches`` are those of
    ``pattern``; the text between comes from a split by it. ``last`` is the end of the text so far."""
    pieces = F.arrays_zip(F.split(text, pattern, -1).alias("g"), matches.alias("m"))

    def step(a, z):
        start = a["at"] + F.length(z["g"])
        end = start + F.length(z["m"])
        before = F.regexp_extract(F.concat(a["last"], z["g"]), BEFORE, 1)
        one = F.struct(start.alias("start"), end.alias("end"), z["m"].alias("m"), before.alias("before")).cast(_ONE)
        state = {"at": F.coalesce(end, start).cast("bigint"), "last": F.coalesce(F.regexp_extract(F.concat(a["last"], z["g"], z["m"]), LAST, 0), F.lit(""))}
        return state, F.when(z["m"].isNotNull(), one)
    return F.when(F.size(matches) > 0, walk(pieces, {"at": F.lit(0).cast("bigint"), "last": F.lit("")}, step, _ONE)).otherwise(F.array().cast(_SPAN))


def apart_from(tokens: Column, plain: Column) -> Column:
    """The tokens that touch no plain span. Tokens are apart from each other, so in order of start a token is touched by the
    farthest end of the plain spans before it or by the plain span that comes next."""
    mark = lambda c, plain_: F.transform(c, lambda s: F.struct(s["start"].alias("start"), F.lit(plain_).alias("plain"), s["end"].alias("end"), s["m"].alias("m"), s["before"].alias("before")))
    order = F.array_sort(F.concat(mark(plain, 0), mark(tokens, 1)))
    pairs = F.arrays_zip(order.alias("s"), F.slice(order, F.lit(2), F.greatest(F.size(order) - 1, F.lit(0))).alias("next"))

    def step(a, z):
        s, next_ = z["s"], z["next"]
        token = s["plain"] == 1
        touched = (a["far"] > s["start"]) | F.coalesce((next_["plain"] == 0) & (next_["start"] < s["end"]), F.lit(False))
        one = F.struct(s["start"].alias("start"), s["end"].alias("end"), s["m"].alias("m"), s["before"].alias("before")).cast(_ONE)
        return {"far": F.when(token, a["far"]).otherwise(F.greatest(a["far"], s["end"]))}, F.when(token & ~touched, one)
    return F.when(F.size(plain) == 0, tokens).otherwise(walk(pairs, {"far": F.lit(-1).cast("bigint")}, step, _ONE))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


VALID = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: F.forall(F.split(m, r"\."), lambda p: p.rlike("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$")),
    "card": lambda m: F.length(_digits(m)).between(13, 19) & F.call_function("luhn_check", F.when(F.length(_digits(m)).between(13, 19), _digits(m)).otherwise("1")),
    "phone": lambda m: F.length(_digits(m)).between(9, 15),
}
PATTERN = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}
HINT = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){12}", "phone": r"\+[0-9]"}


def _passing(found: Column, valid) -> Column:
    return F.filter(found, lambda s: valid(s["m"]))


def scanned(docs: DataFrame) -> DataFrame:
    """One narrow row per document: doc_id, row, a span array per kind, and ``token``: the other tokens with digits."""
    out = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("t"))
    none = F.array().cast("array<string>")
    for k in KINDS:
        out = out.withColumn(f"m_{k}", F.when(F.col("t").rlike(HINT[k]), F.regexp_extract_all("t", F.lit(PATTERN[k]), F.lit(0))).otherwise(none))
    out = out.withColumn("m_token", F.when(F.col("t").rlike("[0-9]"), F.regexp_extract_all("t", F.lit(TOKEN), F.lit(0))).otherwise(none))
    for k in KINDS:
        out = out.withColumn(k, _passing(spans(F.col("t"), F.col(f"m_{k}"), PATTERN[k]), VALID[k]))
    out = out.withColumn("token", spans(F.col("t"), F.col("m_token"), TOKEN))
    # signs around a token are not part of it; a token needs two digits and must not touch a plain span
    core = F.transform("token", lambda s: F.struct(
        (s["start"] + F.length(F.regexp_extract(s["m"], r"^[^0-9A-Za-z]*+", 0))).alias("start"),
        (s["end"] - F.length(F.regexp_extract(s["m"], r"[^0-9A-Za-z]*$", 0))).alias("end"),
        F.regexp_replace(s["m"], r"^[^0-9A-Za-z]++|(?<![^0-9A-Za-z])[^0-9A-Za-z]++$", "").alias("m"), s["before"].alias("before")))
    out = out.withColumn("token", F.filter(core.cast(_SPAN), lambda s: (F.length(_digits(s["m"])) >= 2) & (s["end"] - s["start"] >= 5)))
    plain = F.concat(*[F.col(k) for k in KINDS])
    out = out.withColumn("plain", plain)
    out = out.withColumn("token", apart_from(F.col("token"), F.col("plain")))
    return out.select("doc_id", F.monotonically_increasing_id().alias("row"), *KINDS, "token")


def _pattern(before: Column) -> Column:
    """Two words as a pattern: lower case, one space, digits alike."""
    return F.regexp_replace(F.regexp_replace(F.lower(before), r"[\x20\x09-\x0D]+", " "), "[0-9]", "0")


def specific_patterns(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """Those of (pattern, followed) whose two words are followed by an identifier at half of their places or more.
    Places in some of the documents are a lower bound of all places, so a pattern that fails on a 64th or an 8th of the
    documents fails for certain, and ordinary word pairs are out before the whole corpus is counted."""
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    left = patterns.select("pattern", "followed")
    for part in (64, 8, 1):
        some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(part)) == 0) if part > 1 else docs
        pairs = (some.select(words.alias("w")).where(F.size("w") > 1)
                 .select(F.explode(F.arrays_zip(F.expr("slice(w, 1, size(w) - 1)").alias("a"), F.expr("slice(w, 2, size(w) - 1)").alias("b"))).alias("z"))
                 .select(_pattern(F.concat(F.col("z.a"), F.lit(" "), F.col("z.b"))).alias("pattern")))
        places = pairs.join(left.select("pattern"), "pattern", "left_semi").groupBy("pattern").agg(F.count("*").alias("places"))
        left = materialise(left.join(places, "pattern", "left").where(2 * F.col("followed") >= F.coalesce("places", F.lit(0)))
                           .select("pattern", "followed"))
        if left.isEmpty():
            break
    return left.select("pattern")


def score_graph(edges: DataFrame, base: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(pattern, worth) of the patterns that pass, from edges (pattern, instance) of specific patterns and the worth
    (instance, base) of seeds and earlier finds."""
    graph = edges.select("pattern", "instance")
    state = start = materialise(graph.select("instance").distinct().join(base, "instance", "left")
                                .select("instance", F.coalesce("base", F.lit(0.0)).alias("base"), F.coalesce("base", F.lit(0.0)).alias("worth")))
    patterns = None
    for i in range(rounds):
        patterns = materialise(graph.join(state, "instance").groupBy("pattern")
                               .agg(F.avg("worth").alias("worth"), F.count_if(F.col("worth") >= MIN_WORTH).alias("support"))
                               .where((F.col("support") >= MIN_SUPPORT)))
        if i + 1 < rounds:
            best = graph.join(patterns.select("pattern", F.col("worth").alias("pw")), "pattern").groupBy("instance").agg(F.max("pw").alias("pw"))
            state = materialise(start.join(best, "instance", "left").select("instance", "base", F.greatest("base", F.coalesce("pw", F.lit(0.0))).alias("worth")))
    return materialise(patterns.where(F.col("worth") >= MIN_WORTH).select("pattern", "worth"))


def bootstrap(docs: DataFrame, edges: DataFrame) -> DataFrame:
    """(pattern, worth) of all patterns that seeds, or instances of patterns found before, lead to. Each pattern is held
    against the corpus once. Worth never falls from one generation to the next, so the loop ends."""
    seeds = materialise(edges.where("seed = 1").select("instance", F.lit(1.0).alias("base")).distinct())
    base, good, found = seeds, None, 0
    tried = specific = None
    while True:
        fresh = edges.join(base.where(F.col("base") >= MIN_WORTH), "instance", "left_semi").groupBy("pattern").agg(F.count("*").alias("support")).where(F.col("support") >= MIN_SUPPORT)
        if tried is not None:
            fresh = fresh.join(tried, "pattern", "left_anti")
        followed = edges.join(fresh, "pattern", "left_semi").groupBy("pattern").agg(F.sum("n").alias("followed"))
        fresh = materialise(followed)
        if tried is None or not fresh.isEmpty():
            more = specific_patterns(docs, fresh)
            specific = more if specific is None else materialise(specific.unionByName(more))
            tried = fresh.select("pattern") if tried is None else materialise(tried.unionByName(fresh.select("pattern")))
        graph = materialise(edges.join(specific, "pattern", "left_semi"))
        good = score_graph(graph, base)
        n = good.count()
        if n == found:
            return good
        found = n
        finds = graph.join(good, "pattern").groupBy("instance").agg(F.max("worth").alias("base"))
        base = materialise(seeds.unionByName(finds).groupBy("instance").agg(F.max("base").alias("base")))


def find_personal_data(docs: DataFrame) -> DataFrame:
    """One row per document: counts by kind, digest of the plain spans, all spans."""
    found = materialise(scanned(docs))
    seen = None
    for k in (*KINDS, "token"):
        part = found.select("row", F.explode(k).alias("s")).where("s.before <> ''").select(
            "row", F.lit(k != "token").cast("int").alias("seed"), _pattern(F.col("s.before")).alias("pattern"), F.col("s.m").alias("instance"), "s.start", "s.end")
        seen = part if seen is None else seen.unionByName(part)
    seen = materialise(seen)
    edges = materialise(seen.groupBy("pattern", "instance").agg(F.max("seed").alias("seed"), F.count("*").alias("n")))
    good = bootstrap(docs, edges)
    new = (seen.where("seed = 0").join(good, "pattern", "left_semi").groupBy("row")
           .agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("context")).select(F.col("row").alias("_r"), "context"))
    out = found.join(new, F.col("row") == F.col("_r"), "left")

    def line(k):
        return F.transform(k, lambda s: F.concat(F.lit(f"{k}:"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string")))
    base = F.concat(*[line(k) for k in KINDS])
    more = F.coalesce(line("context"), F.array().cast("array<string>"))
    return out.select("doc_id", *[F.size(k).cast("bigint").alias(f"n_{k}") for k in KINDS],
                      F.coalesce(F.size("context"), F.lit(0)).cast("bigint").alias("n_context"),
                      F.sha2(F.array_join(base, ",").cast("binary"), 256).alias("base_sha256"), F.array_join(F.concat(base, more), ",").alias("spans"))


@query("op9_personal_data")
def op9_personal_data(spark, sf_dir):
    return find_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))
