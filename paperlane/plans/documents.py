"""From lines of documents to records: detect, extract, check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from paperlane.config import CaptureConfig, Profile, select_profiles
from paperlane.functions.text import normalize
from paperlane.functions.wire import VERSION
from paperlane.model import EXTRACTED, TEXT_LAYER
from paperlane.operators import detect as D, extract as X, rules as C

PROFILE = "document_profile"


def detected(docs: DataFrame, profiles: list[Profile], source: Column | None = None, how: str = "native", normal: Column | None = None) -> DataFrame:
    """``docs`` (with ``lines``) with the score ``sheet``, the extracted ``profile`` and ``profile_id`` (null where undecided)."""
    scored = docs.withColumn("sheet", D.score_profiles(D.haystack(F.col("lines"), how, normal), profiles))
    return scored.withColumn("profile", D.decide(F.col("sheet"), source)).withColumn("profile_id", F.col("profile.text"))


def extracted_fields(docs: DataFrame, profile: Profile, config: CaptureConfig, source: Column | None = None, how: str = "native", locator: str = "L%d", only: Column | None = None, normal: Column | None = None) -> DataFrame:
    """``docs`` with a column ``<profile>.<key>`` for each field, after the rules, and ``<profile>.notes`` and ``.outcomes``."""
    p = f"{profile.profile_id}."
    chosen = lambda c: c if only is None or c is None else F.when(only, c)
    claimed = docs.withColumn(f"{p}claims", X.claims(chosen(F.col("lines")), profile.fields, how, chosen(normal)))
    found = claimed.withColumns({f"{p}hits.{s.key}": X.hits(F.col("lines"), F.col(f"`{p}claims`"), k, s) for k, s in enumerate(profile.fields)})
    hits = {s.key: F.col(f"`{p}hits.{s.key}`") for s in profile.fields}
    human = set(config.human_only_field_types)
    items = found.withColumns({f"{p}{s.key}": X.field(F.coalesce(hits[s.key], F.array().cast(f"array<{X.HIT}>")), s, config.tabular, source, bool(s.field_type) and s.field_type in human, locator) for s in profile.fields})
    notes = F.array(*[X.field_note(hits[s.key], F.col(f"`{p}{s.key}`"), s) for s in profile.fields]).cast("array<string>")
    noted = items.withColumn(f"{p}notes", F.filter(notes, lambda n: n.isNotNull()))
    return C.apply_rules(noted, profile.rules, config.redundancy_tolerance, p, f"{p}outcomes").drop(f"{p}claims", *[f"{p}hits.{s.key}" for s in profile.fields])


def analyze(docs: DataFrame, profiles: list[Profile], config: CaptureConfig, input_kind: str = TEXT_LAYER, how: str = "native", locator: str = "L%d") -> DataFrame:
    """One record for each row of ``docs`` (relative_path, content_hash, lines), in one scan without a shuffle.

    Where the type isn't decided only ``document_profile`` is given: fields
    of a wrong type would look right.
    """
    chosen = select_profiles(profiles, config.enabled_profiles)
    proof = F.struct(F.col("relative_path").alias("relative_path"), F.col("content_hash").alias("content_hash"), F.lit(None).cast("string").alias("locator"))
    read = docs.withColumn("lines", F.coalesce("lines", F.array().cast("array<string>"))).withColumn("evidence", proof)
    normal = None
    if how == "native":  # once for detection and all profiles
        read, normal = read.withColumn("__normal", F.transform("lines", lambda x: normalize(x))), F.col("__normal")
    done = detected(read, chosen, F.col("evidence"), how, normal)
    first = F.create_map(F.lit(PROFILE), F.col("profile"))
    fields, notes = first, F.array(F.lit("profile_undecided: no fields are extracted"))
    for p in chosen:
        own = F.col("profile_id") == p.profile_id
        done = extracted_fields(done, p, config, F.col("evidence"), how, locator, own, normal)
        named = F.create_map(*[x for s in p.fields for x in (F.lit(s.key), F.col(f"`{p.profile_id}.{s.key}`"))]) if p.fields else F.create_map().cast(f"map<string,{EXTRACTED}>")
        fields = F.when(own, F.map_concat(first, named)).otherwise(fields)
        notes = F.when(own, F.concat(F.col(f"`{p.profile_id}.notes`"), C.outcome_notes(F.col(f"`{p.profile_id}.outcomes`")))).otherwise(notes)
    record = done.select(
        F.lit(VERSION).alias("contract_version"),
        F.lit(input_kind).alias("input_kind"),
        "evidence",
        fields.alias("fields"),
        F.array().cast(f"array<map<string,{EXTRACTED}>>").alias("rows"),
        F.concat(D.score_notes(F.col("sheet")), notes).alias("diagnostics"),
    )
    return record.withColumn("needs_human", F.exists(F.map_values("fields"), lambda v: v["confidence"] != "confirmed"))
