"""A whole profiling run: documents of many collections in, profile tables out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docstrata.operators import describe, drift, fields, relate, reports, sampling, variants
from docstrata.operators.flatten import classify, flatten_documents
from docstrata.options import ProfileOptions
from docstrata.session import cut_lineage
from docstrata.sources import store


@dataclass(frozen=True)
class Profile:
    catalog: DataFrame
    fields: DataFrame
    variants: DataFrame
    truncation: DataFrame
    warnings: DataFrame
    fingerprints: DataFrame
    summaries: DataFrame
    rejected: DataFrame
    drift: DataFrame | None
    preserved: DataFrame | None
    strategy: str
    sample_size: int | None
    options: ProfileOptions


def _counts(documents: DataFrame) -> DataFrame:
    """Per collection, in one look: documents, those that did not parse, those that have path rows."""
    whole = documents.withColumn("s", F.expr("schema_of_variant(v)")).withColumn("first", F.expr("try_variant_get(v, '$[0]', 'variant')"))
    with_rows = (F.startswith("s", F.lit("OBJECT<")) & (F.col("s") != "OBJECT<>")) | F.col("first").isNotNull()
    return whole.groupBy("collection").agg(
        F.count(F.lit(1)).alias("documents"), F.count_if(F.col("v").isNull()).alias("rejected"), F.count_if(with_rows).alias("with_rows")
    )


def profile_documents(
    documents: DataFrame,
    options: ProfileOptions = ProfileOptions(),
    previous: DataFrame | None = None,
    answers: DataFrame | None = None,
    summary_answers: DataFrame | None = None,
    force: bool = False,
    sampled: bool = False,
) -> Profile:
    """Profile documents(collection, doc_id, v) of all collections in one job per table.

    `previous` is an earlier profile (see `load_schema_json`) whose descriptions and summaries are
    reused, whose collections that are gone are kept, and against which drift is reported;
    `answers(collection, path, description, seq)` and `summary_answers(collection, text)` are new
    ones. With `sampled`, `options.sample_size` documents of each collection are profiled instead of
    all. Results are stored once, since they are small next to the documents and read by every report.
    """
    if sampled:
        documents = sampling.per_collection_sample(documents, options.sample_size)
    counted = cut_lineage(_counts(documents))
    rejected = counted.where("rejected > 0").select("collection", "rejected", "documents")
    totals = counted.where("documents > rejected").select("collection", (F.col("documents") - F.col("rejected")).alias("docs"))
    if "levels" not in documents.columns:
        documents = classify(documents, options)
    paths = flatten_documents(documents, options)
    profiled = fields.profile_collection(paths, totals, options)
    earlier = None if previous is None or force else store.stored_descriptions(previous)
    if earlier is not None:
        profiled = drift.carry_descriptions(profiled, earlier)
    if answers is not None:
        profiled = describe.apply_descriptions(profiled, answers)
    profiled = cut_lineage(profiled)
    shapes = cut_lineage(variants.variant_analysis(documents, options))
    capped = any(cap is not None for cap in (options.max_depth, options.max_keys_per_doc, options.max_array_sample))
    # without caps nothing is cut, so the documents need not be expanded once more to count it
    truncation = cut_lineage(fields.truncation_counters(paths, options)) if capped else fields.nothing_truncated(counted.where("with_rows > 0"))
    hits = fields.pii_fields(profiled).select("collection", "pii_field_count")
    run = totals.select("collection", F.col("docs").alias("sampled"), F.lit(False).alias("fallback"))
    warnings = fields.collection_warnings(run.join(hits, "collection", "left"))
    types = profiled.select("collection", "path", F.explode("types").alias("t")).select("collection", "path", "t.type")
    changes = preserved = None
    if previous is not None:
        # Stored now: the earlier profile's folder may be written over before this is read.
        old = cut_lineage(store.stored_fields(previous))
        before = old.select("collection", "path", F.explode("types").alias("t")).select("collection", "path", "t.type")
        preserved = cut_lineage(drift.removed_collections(totals, previous))
        stayed = before.join(preserved.select("collection"), "collection", "left_anti")
        changes = cut_lineage(drift.schema_drift(stayed, types))
    summaries = documents.sparkSession.createDataFrame([], "collection string, summary string")
    if previous is not None and not force:
        summaries = cut_lineage(store.stored_summaries(previous))
    if summary_answers is not None:
        new = describe.parse_summary_answers(summary_answers).where("summary is not null")
        summaries = cut_lineage(summaries.join(new.select("collection"), "collection", "left_anti").unionByName(new))
    return Profile(
        catalog=totals.withColumnRenamed("docs", "est_count"),
        fields=profiled,
        variants=shapes,
        truncation=truncation,
        warnings=warnings,
        fingerprints=drift.schema_fingerprint(types),
        summaries=summaries,
        rejected=rejected,
        drift=changes,
        preserved=preserved,
        strategy="random" if sampled else "all",
        sample_size=options.sample_size if sampled else None,
        options=options,
    )


def description_queue(profile: Profile, answered: DataFrame, max_fields: int | None = None) -> DataFrame:
    """Description inputs still waiting for an answer(key)."""
    wanted = describe.top_fields_by_presence(profile.fields, max_fields)
    if "description" in wanted.columns:
        wanted = wanted.where("description is null or description = ''")
    context = relate.fk_context(wanted, relate.fk_candidates(profile.fields))
    return describe.description_work_queue(describe.description_inputs(wanted, context), answered)


def write_profile(profile: Profile, folder: str, keys: DataFrame | None = None, update: bool = False) -> None:
    """The profile as JSON plus one report table per folder.

    With `update` only the collections of this profile are replaced in what the folder holds; all others stay.
    """
    save = store.update_schema_json if update else store.write_schema_json
    save(f"{folder}/schema", profile.fields, profile.variants, profile.summaries)
    totals = profile.catalog.withColumnRenamed("est_count", "docs")
    overview = reports.collection_overview(totals, profile.fields, profile.variants, profile.warnings, profile.catalog)
    run = reports.overview_report(
        profile.truncation, fields.pii_fields(profile.fields), profile.catalog, profile.options, profile.strategy, profile.sample_size
    )
    tables = {
        "overview": overview,
        "run": run,
        "fields": reports.field_report(profile.fields),
        "variants": reports.variant_report(profile.variants),
    }
    tables["rejected"] = profile.rejected
    if profile.drift is not None:
        tables |= {"drift": profile.drift, "preserved": profile.preserved}
    if keys is not None:
        tables["keys"] = reports.key_report(keys)
    (store.update_reports if update else store.write_reports)(folder, tables)
