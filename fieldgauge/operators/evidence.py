"""Merging per-field evidence into final values.

Evidence arrives as tables keyed like the entities, one per source. ``gather``
deals the tagged rows of all sources by key in one exchange, folds them into one
row per key and joins that to the entities once; everything after is a narrow
chain of column expressions.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from fieldgauge import fixed_values as fv
from fieldgauge.config import EvidenceRules
from fieldgauge.functions import bands
from fieldgauge.functions.text import bare_domain, is_missing, name_matches_domain, platform_by_prefix, present
from fieldgauge.operators.cleaning import address_signals, infer_type
from fieldgauge.operators.labels import snap_cascade, snap_method, tidy, with_divergence
from fieldgauge.operators.running import running_total
from fieldgauge.operators.scale import left_lookup
from fieldgauge.sources.workspace import materialise

FIELDS = ("website", "type", "industry", "size")
LARGE = ("1K-5K", "5K-10K", "10K+")

FINDING = ("candidate_website string, website_confidence double, candidate_type string, type_confidence double, "
           "candidate_size string, size_confidence double, industry_snapped string, industry_confidence double, "
           "extracted_name string, naics_2digit int, still_operating boolean, closure_signals array<string>, "
           "is_single_facility boolean, search_used boolean, error boolean")
SOURCES = {
    "found": FINDING,
    "retry": FINDING,
    "gate": "entity_verdict string",
    "verify": "website_verified boolean, website_confidence double",
    "sized": "candidate_size string, size_confidence double, error boolean",
    "closed": "still_operating boolean, closure_signals array<string>, error boolean",
    "resolved": ("website_final string, website_confidence double, type_final string, type_confidence double, "
                 "size_final string, size_confidence double, industry_final string, industry_confidence double, "
                 "error boolean"),
}


@dataclass(frozen=True)
class StageNames:
    """Labels written to the provenance columns."""

    none: str = "NO_CANDIDATE"
    resolved: str = "resolved"
    searched: str = "searched"
    parametric: str = "parametric"


def gather(entities: DataFrame, evidence: dict[str, DataFrame], key: str = "handle") -> DataFrame:
    """Entities with one nullable struct column per evidence source. A source has at most one row per key; rows without
    a key belong to nobody. The union is dealt by key before it is folded, so the fold needs no partial step and its
    order serves the join too. Rows are ordered by a hash of the key first: keys often start alike, so that comparing
    them would read both texts each time, while a number decides nearly all comparisons by itself."""
    kinds = {name: f"struct<{ddl}>" for name, ddl in SOURCES.items()}
    sides = []
    for name, kind in kinds.items():
        if name in evidence:
            fields = [c.split()[0] for c in SOURCES[name].split(", ")]
            mine = F.struct(*fields).cast(kind)
            sides.append(evidence[name].where(F.col(key).isNotNull()).select(
                F.col(key).alias("_key"), *[(mine if n == name else F.lit(None).cast(k)).alias(n) for n, k in kinds.items()]))
    if not sides:
        return entities.withColumns({n: F.lit(None).cast(k) for n, k in kinds.items()})
    tagged = reduce(DataFrame.unionByName, sides)
    folded = (tagged.repartition(F.xxhash64("_key"), "_key").groupBy(F.xxhash64("_key").alias("_hash"), "_key")
              .agg(*[F.first(n, ignorenulls=True).alias(n) for n in kinds]))
    return entities.join(folded, (F.xxhash64(key) == F.col("_hash")) & (F.col(key) == F.col("_key")), "left").drop("_hash", "_key")


def snap_raw_labels(found: DataFrame, labels: DataFrame, key: str = "handle", raw: str = "industry_raw", **steps) -> DataFrame:
    """``found`` with ``industry_snapped`` from its raw label texts. Every distinct text goes through the cascade once;
    a text that many rows share reaches them by broadcast, the others by a shuffle in which no key is hot."""
    rows = found.drop("industry_snapped").withColumn("_text", F.coalesce(tidy(raw), F.lit("")))
    counts = rows.groupBy("_text").agg(F.count("*").alias("_rows"))
    snapped = snap_cascade(counts.select(F.col("_text").alias("text")), labels, **steps)
    side = materialise(counts.join(snapped, F.col("_text") == F.col("text"), "left")
                       .select("_text", "_rows", F.col("label").alias("industry_snapped")))   # read for hot and other texts
    return left_lookup(rows, side, "_text", key, "_rows", ["industry_snapped"]).drop("_text")


def _flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _num(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def route(df: DataFrame) -> DataFrame:
    """Adds address and name signals and ``needs_search``: the address is known to
    be absent or a platform page, or it does not fit the name. What later steps ask of the address again is kept."""
    fits = name_matches_domain("name", "website")
    return (df.withColumns({"site0": bare_domain("website"), "on_platform": platform_by_prefix("website"),
                            **address_signals("website"), "hint": infer_type("name", "website")})
            .withColumn("needs_search", _flag(F.col("poc_condition").isin("missing_website", "platform_url")) | ~fits))


def compare_names(df: DataFrame, rules: EvidenceRules = EvidenceRules()) -> DataFrame:
    """Adds ``names_differ``. Names are put in columns of their own, and only where the comparison decides whether the
    found entity is verified, so that it is made once and for few rows."""
    found = F.col("found")
    df = df.withColumn("nothing_found", is_missing(found["candidate_website"]) & is_missing(found["candidate_type"]))
    settled = [F.col("nothing_found"), F.col("hint.confirmed"),
               F.col("website_corrupted"), F.col("size").isin(*LARGE)]
    undecided = F.col("needs_search") & ~reduce(lambda a, b: a | b, [_flag(c) for c in settled])
    named = F.coalesce(found["extracted_name"], F.lit("")) != ""
    theirs = df.withColumn("_theirs", F.when(undecided & named, found["extracted_name"]))
    compared = with_divergence(theirs, "name", "_theirs", "names_differ", rules.name_diverges_below)
    return compared.withColumn("names_differ", _flag(F.col("names_differ"))).drop("_theirs")


def needs_gate() -> Column:
    """Should the found entity be verified? First rule that applies decides."""
    theirs = bare_domain(F.col("found.candidate_website"))
    same_stem = F.substring_index("site0", ".", 1) == F.substring_index(theirs, ".", 1)
    return (F.when(F.col("nothing_found"), False)
            .when(F.col("hint.confirmed"), False)
            .when(F.col("website_corrupted"), False)
            .when(F.col("size").isin(*LARGE), True)
            .when(F.col("names_differ"), True)
            .when(_flag(same_stem) & ~F.col("on_platform"), False)
            .otherwise(True))


def apply_verdict(df: DataFrame, rules: EvidenceRules = EvidenceRules()) -> DataFrame:
    """``verdict`` and the evidence that survives it in ``ev``: dropped on
    NO_MATCH or error, replaced by a clean retry for SUBSIDIARY and PARENT."""
    df = (compare_names(df, rules).withColumn("failed", _flag(F.col("found.error")))
          .withColumn("gated", ~F.col("failed") & F.col("needs_search") & needs_gate()))
    df = df.withColumn("verdict", F.when(F.col("gated"), F.coalesce("gate.entity_verdict", F.lit("MATCH"))).otherwise("MATCH"))
    related = F.col("verdict").isin("SUBSIDIARY", "PARENT")
    retry_ok = F.col("retry").isNotNull() & ~_flag(F.col("retry.error"))
    nothing = F.lit(None).cast(f"struct<{FINDING}>")
    dropped = F.col("failed") | (F.col("verdict") == "NO_MATCH")
    return (df.withColumn("dropped", dropped)
            .withColumn("ev", F.when(dropped, nothing).when(related & retry_ok, F.col("retry")).otherwise(F.col("found"))))


def merge_fields(df: DataFrame, rules: EvidenceRules = EvidenceRules()) -> DataFrame:
    """Values and confidences after labels, type hints, verification, the size
    search and the closure check."""
    ev, live = F.col("ev"), ~F.col("dropped")
    hint = F.col("hint")
    label = snap_method(hint["industry"], hint["confirmed"], present(ev["industry_snapped"]),
                        ev["naics_2digit"], F.col("industry"))
    hinted = live & hint["type"].isNotNull() & is_missing(ev["candidate_type"])
    df = df.withColumns({
        "label": F.when(live, label),
        "t_val": F.when(hinted, hint["type"]).otherwise(ev["candidate_type"]),
        "t_conf": F.when(hinted, hint["confidence"]).otherwise(_num(ev["type_confidence"])),
        "audience": F.when(live, bands.audience(ev["naics_2digit"])),
        "w_val": bare_domain(ev["candidate_website"]),
        "w_conf0": _num(ev["website_confidence"]),
        "s_conf0": _num(ev["size_confidence"]),
    })
    checked = (live & F.col("w_val").isNotNull() & F.col("needs_search")
               & (F.col("w_conf0") < rules.verify_below) & F.col("verify").isNotNull())
    verified = F.when(checked, F.col("verify.website_verified"))
    size_wanted = live & (
        (((F.col("verdict") == "MATCH") | hint["confirmed"])
         & (is_missing(ev["candidate_size"]) | (F.col("s_conf0") < rules.size_search_below)))
        | F.col("verdict").isin("PARENT", "SUBSIDIARY"))
    sized = F.col("sized")
    size_taken = (size_wanted & ~_flag(sized["error"]) & ~is_missing(sized["candidate_size"])
                  & (_num(sized["size_confidence"]) > F.col("s_conf0")))
    closed = F.col("closed")
    closure_taken = (live & ev["still_operating"].isNull() & ~_flag(closed["error"]) & closed["still_operating"].isNotNull())
    return df.withColumns({
        "was_checked": checked, "verified": verified,
        "w_conf1": F.when(verified, F.greatest("w_conf0", F.coalesce("verify.website_confidence", "w_conf0")))
                    .when(~verified, F.least(F.col("w_conf0"), F.lit(rules.refuted_cap))).otherwise(F.col("w_conf0")),
        "s_val": F.when(_flag(size_taken), sized["candidate_size"]).otherwise(ev["candidate_size"]),
        "s_conf": F.when(_flag(size_taken), sized["size_confidence"]).otherwise(F.col("s_conf0")),
        "still_operating": F.when(_flag(closure_taken), closed["still_operating"]).otherwise(ev["still_operating"]),
        "closure_signals": F.coalesce(
            F.when(_flag(closure_taken), closed["closure_signals"]).otherwise(ev["closure_signals"]),
            F.array().cast("array<string>")),
        "i_conf": _num(ev["industry_confidence"]),
    })


def uncertain_fields(rules: EvidenceRules = EvidenceRules()) -> Column:
    """Fields still below the escalation confidence, in a fixed order."""
    low = rules.escalate_below
    site = F.col("w_val").isNotNull()
    w = site & ((F.col("needs_search") & (F.col("w_conf1") < low)) | _flag(~F.col("verified")))
    t = ~is_missing("t_val") & (F.col("t_conf") < low)
    s = ~is_missing("s_val") & (F.col("s_conf") < low) & site
    i = F.col("label.label").isNotNull() & (F.col("i_conf") < low)
    tags = F.array_compact(F.array(F.when(w, "website"), F.when(t, "type"), F.when(s, "size"), F.when(i, "industry")))
    return F.when(F.col("dropped"), F.array().cast("array<string>")).otherwise(tags)


def finalise(df: DataFrame, rules: EvidenceRules = EvidenceRules(), names: StageNames = StageNames()) -> DataFrame:
    """Final values with provenance, validity, review flags and status. Blank checks are columns read several times; the
    steps are kept this small because the JVM interprets, and never compiles, a generated method above 8,000 bytes."""
    df = df.withColumn("uncertain", uncertain_fields(rules))
    df = (df.withColumn("escalated", (F.size("uncertain") > 0) & F.col("resolved").isNotNull())
          .withColumn("rz", F.when(F.col("escalated") & ~_flag(F.col("resolved.error")), F.col("resolved"))))
    rz = F.col("rz")
    given = df.withColumns({f"_new_{f}": present(rz[f"{f}_final"]) for f in FIELDS} | {f"_old_{f}": present(f) for f in FIELDS})
    base = {"website": F.col("ev.candidate_website"), "type": F.col("t_val"), "industry": F.col("label.label"), "size": F.col("s_val")}
    conf = {"website": F.col("w_conf1"), "type": F.col("t_conf"), "industry": F.col("i_conf"), "size": F.col("s_conf")}
    cand = {f: F.coalesce(F.col(f"_new_{f}"), base[f]) for f in FIELDS}
    cand["website"] = bare_domain(cand["website"])
    cand["type"] = F.when(cand["type"].isin(*fv.ENTITY_TYPES), cand["type"])
    cand["size"] = F.when(cand["size"].isin(*fv.SIZE_BANDS), cand["size"])
    df = given.withColumns({f"{f}_enriched": cand[f] for f in FIELDS}
                           | {f"{f}_confidence": F.coalesce(rz[f"{f}_confidence"], conf[f]) for f in FIELDS})

    out: dict[str, Column] = {}
    for f in FIELDS:
        new, at = F.col(f"{f}_enriched"), rules.accept.of(f)
        sure = F.col(f"{f}_confidence") >= at
        old = F.col(f"_old_{f}")
        if f == "website":
            usable = F.when(~F.col("website_rules_flag"), F.col("site0"))
            final = F.coalesce(F.when(sure, new), usable, new)
            right = F.when(old.isNotNull() & (F.col("w_conf1") >= at), new == F.col("site0"))
        else:
            final = F.coalesce(F.when(sure, new), old, new)
            right = F.when(old.isNotNull() & sure, new == F.col(f))
        stage = F.when(final.isNull(), names.none).when(F.col(f"_new_{f}").isNotNull(), names.resolved)
        if f == "website":
            stage = stage.when(F.col("was_checked"), names.searched)
        out |= {f"{f}_original": F.col(f), f"{f}_final": final, f"{f}_original_correct": right,
                f"{f}_pipeline_stage": stage.when(F.col("ev.search_used"), names.searched).otherwise(names.parametric),
                f"{f}_review_flag": ~sure & new.isNotNull()}
    df = df.withColumns(out)
    filled = reduce(lambda a, b: a + b, [(F.col(f"{f}_final").isNotNull() & F.col(f"_old_{f}").isNull()).cast("int") for f in FIELDS])
    df = df.withColumn("_filled", filled)
    refuted = F.col("website_enriched").isNotNull() & ~F.col("verified") & ~F.col("escalated")
    return df.withColumns({
        "operating_status_review_flag": F.col("still_operating").isNull() | (F.size("closure_signals") > 0),
        "enrichment_status": F.when(F.col("failed"), "ERROR").when(refuted, "CONFLICT").when(F.col("_filled") == 0, "NO_CANDIDATE")
                              .when(F.col("_filled") >= 2, "FULLY_ENRICHED").otherwise("PARTIALLY_ENRICHED"),
        "stage_resolved": F.when(F.col("failed"), 1).when(F.col("dropped"), 0).when(F.col("escalated"), 4)
                           .when(F.col("was_checked"), 3).when(F.col("gated"), 2).otherwise(1),
        "status": F.when(F.col("failed"), "error").otherwise("completed"),
        "b2b_vs_b2c": F.col("audience"), "is_single_facility": F.col("ev.is_single_facility"),
        "industry_snap_method": F.col("label.method"),
    }).drop("_filled", *[f"_{x}_{f}" for x in ("new", "old") for f in FIELDS])


OUTPUT = (["handle", "name", "city", "state", "poc_segment", "poc_condition"]
          + [f"{f}_{x}" for f in FIELDS for x in ("original", "enriched", "final", "original_correct", "confidence",
                                                  "pipeline_stage", "review_flag")]
          + ["operating_status_review_flag", "enrichment_status", "stage_resolved", "status", "still_operating",
             "closure_signals", "is_single_facility", "b2b_vs_b2c", "industry_snap_method"])


def resolve(entities: DataFrame, evidence: dict[str, DataFrame], rules: EvidenceRules = EvidenceRules(),
            names: StageNames = StageNames(), trace: bool = False, labels: DataFrame | None = None,
            version: str | None = None) -> DataFrame:
    """The whole merge. ``trace`` keeps the working columns next to the output. With ``labels``, raw label texts of the
    findings (``industry_raw``) are snapped to them first; with ``version``, rows carry it as ``pipeline_version``."""
    df = finalise(merge_fields(apply_verdict(route(gather(entities, snapped(evidence, labels))), rules), rules), rules, names)
    if version is not None:
        df = df.withColumn("pipeline_version", F.lit(version))
    return df if trace else df.select(*OUTPUT, *(["pipeline_version"] if version is not None else []))


def snapped(evidence: dict[str, DataFrame], labels: DataFrame | None) -> dict[str, DataFrame]:
    """The evidence with raw label texts of its findings snapped to ``labels``."""
    if labels is None:
        return evidence
    return {n: snap_raw_labels(df, labels) if "industry_raw" in df.columns else df for n, df in evidence.items()}


def resolve_within_budget(entities: DataFrame, evidence: dict[str, DataFrame], costs: DataFrame, cap: float, order: Sequence[str],
                          rules: EvidenceRules = EvidenceRules(), names: StageNames = StageNames(), key: str = "handle",
                          labels: DataFrame | None = None, version: str | None = None) -> DataFrame:
    """The merge of a run that stops spending at ``cap``. Entities are worked in ``order``, which is unique; ``costs`` has
    (key, cost, closing_cost), what an entity's calls cost and which part of it is the closure check, the last but one
    step. An entity reached with the cap spent is not worked: it keeps its identity with status budget_exhausted, no
    candidate and stage 0. One whose own calls reach the cap goes without the closure check."""
    price = costs.select(F.col(key).alias("_key"), "cost", "closing_cost")
    priced = (entities.join(price, F.col(key) == F.col("_key"), "left").drop("_key")
              .withColumns({"cost": F.coalesce("cost", F.lit(0)), "closing_cost": F.coalesce("closing_cost", F.lit(0))}))
    worked = running_total(priced, order, "cost")
    left = F.col("running") - F.col("cost")
    worked = (worked.withColumns({"_exhausted": left >= cap, "_closes": F.col("running") - F.col("closing_cost") < cap})
              .drop("running", "cost", "closing_cost"))
    met = gather(worked, snapped(evidence, labels), key)
    met = met.withColumn("closed", F.when(F.col("_closes"), F.col("closed")))
    df = finalise(merge_fields(apply_verdict(route(met), rules), rules), rules, names)
    spent = {"status": "budget_exhausted", "enrichment_status": "NO_CANDIDATE", "stage_resolved": 0}
    ids = ("handle", "name", "city", "state", "poc_segment", "poc_condition")
    cols = [F.when(~F.col("_exhausted"), F.col(c)).otherwise(F.lit(spent.get(c))).alias(c) if c not in ids else F.col(c) for c in OUTPUT]
    return df.select(*cols, *([F.lit(version).alias("pipeline_version")] if version is not None else []))


def size_delta_flag(old: Column | str = "size_original", new: Column | str = "size_enriched", bands_apart: int = 1) -> Column:
    """Sizes more than ``bands_apart`` bands apart; false when either is no band."""
    gap = F.abs(bands.size_ordinal(old) - bands.size_ordinal(new))
    return F.coalesce(gap > bands_apart, F.lit(False))


def parse_responses(log: DataFrame, schema: str, text: str = "raw") -> DataFrame:
    """Raw responses to a struct: the fenced block if it parses, else the widest
    {...}, else a failed row that stays in the output."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.+?)\s*```", 1)
    bare = F.regexp_extract(text, r"(?s)(\{.+\})", 1)

    def parse(c: Column) -> Column:
        ok = F.try_parse_json(F.nullif(c, F.lit(""))).isNotNull()
        return F.when(ok, F.from_json(c, schema))

    return (log.withColumn("parsed", F.coalesce(parse(fenced), parse(bare)))
            .withColumn("outcome", F.when(F.col("parsed").isNotNull(), "success").otherwise("invalid_json")))
