"""Reports after an appointment: recode, store without free text, gather, group with a threshold flag."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quaystone.functions.dates import iso_week
from quaystone.sources.schemas import CAUSE, CAUSES, REPORT

THRESHOLD, EXAMPLES = 5, 5


def all_reports(*tables: DataFrame) -> DataFrame:
    """The union of report tables; columns that one lacks are null."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def causes(spark) -> DataFrame:
    return spark.createDataFrame(CAUSES, CAUSE)


def report_groups(reports: DataFrame, cause_table: DataFrame, threshold: int = THRESHOLD, examples: int = EXAMPLES, since_week: str | None = None, strict: bool = True) -> DataFrame:
    """Reports that didn't go well, by service and cause: count, simulated ones, whether the threshold is reached, first examples by text.

    A null outcome isn't ``ok``. Groups below the threshold stay. The cause table is small and joined after the aggregation; with
    ``strict`` an unknown cause is an error, else its label is null. ``since_week`` (``2026-W05``) leaves older reports out. Of a group's
    distinct texts, each task sends on the first few alone.
    """
    bad = reports.where(~F.col("outcome").eqNullSafe("ok"))
    if since_week:
        bad = bad.where(F.col("week") >= since_week)
    grouped = bad.groupBy("service_id", "cause").agg(
        F.count("*").alias("count"),
        F.sum(F.coalesce(F.col("simulated"), F.lit(False)).cast("long")).alias("simulated"),
        (F.count("*") >= threshold).alias("over_threshold"),
    )
    said = bad.select("service_id", "cause", F.explode(F.array(*(F.struct(F.lit(c).alias("of"), F.col(c).alias("said")) for c in ("summary_en", "summary_it")))).alias("x"))
    said = said.select("service_id", "cause", "x.*").where("said is not null").distinct()
    by_text = Window.partitionBy("service_id", "cause", "of").orderBy("said")
    few = said.withColumn("nth", F.row_number().over(by_text)).where(F.col("nth") <= examples)
    of = lambda c: F.array_sort(F.collect_list(F.when(F.col("of") == c, F.col("said"))))
    few = few.groupBy(F.col("service_id").alias("_service"), F.col("cause").alias("_cause")).agg(of("summary_en").alias("examples_en"), of("summary_it").alias("examples_it"))
    grouped = grouped.join(few, F.col("service_id").eqNullSafe(F.col("_service")) & F.col("cause").eqNullSafe(F.col("_cause")), "left")
    none = F.array().cast("array<string>")
    grouped = grouped.withColumns({c: F.coalesce(c, none) for c in ("examples_en", "examples_it")}).drop("_service", "_cause")
    out = grouped.join(cause_table, "cause", "left")
    if strict:
        known = F.col("cause_label").isNotNull()
        out = out.withColumn("cause_label", F.when(known, F.col("cause_label")).otherwise(F.raise_error(F.concat(F.lit("unknown cause: "), F.coalesce("cause", F.lit("null"))))))
    return out.select("service_id", "cause", "cause_label", "recipient", "count", "simulated", "over_threshold", "examples_en", "examples_it")


def ordered(groups: DataFrame) -> DataFrame:
    """Largest first; equal counts by service and cause."""
    return groups.orderBy(F.desc("count"), "service_id", "cause")


def suppressed(groups: DataFrame) -> DataFrame:
    """What may be published: groups over the threshold, without examples."""
    return groups.where("over_threshold").select("service_id", "cause", "cause_label", "count")


def recode_outcome(answer: Column, codes: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for kv in codes.items() for x in kv))[answer]


def routing_label(simulated: Column, over_threshold: Column) -> Column:
    return F.when(over_threshold & (simulated > 0), "routed (simulated)").when(over_threshold, "routed").otherwise("collecting")


Classifier = Callable[[str, str, str], dict[str, str]]


def rule_classifier(service_id: str, outcome: str, note: str) -> dict[str, str]:
    """A fixed rule in place of a model: cues in the note choose the cause; the summaries hold nothing of the note."""
    low = (note or "").lower()
    cause = next((c for cue, c in (("wrong office", "ufficio-sbagliato"), ("old", "procedura-non-aggiornata"), ("no page", "procedura-mancante"), ("asked for", "richiesta-non-prevista"), ("did not read", "non-seguita")) if cue in low), "pagina-incompleta")
    return {"cause": cause, "summary_it": f"Segnalazione: {cause}", "summary_en": f"Report: {cause}"}


def classify(notes: DataFrame, classifier: Classifier = rule_classifier, keep: tuple[str, ...] = ()) -> DataFrame:
    """(service_id, outcome, note, day) to report rows, after the columns to ``keep``. The note itself is no column of the result.

    The classifier runs on the executors, once a row; a cause outside the list is an error.
    """
    known = {c[0] for c in CAUSES}
    kept = [notes.schema[c] for c in keep]
    schema = T.StructType([*kept, *(REPORT[c] for c in ("service_id", "outcome", "cause", "summary_it", "summary_en")), T.StructField("day", T.DateType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found = [classifier(*x) for x in zip(f["service_id"], f["outcome"], f["note"], strict=True)]
            if wrong := {x["cause"] for x in found} - known:
                raise ValueError(f"not a cause: {sorted(wrong)}")
            yield pd.DataFrame({**{c: f[c] for c in keep}, "service_id": f["service_id"], "outcome": f["outcome"], **{k: [x[k] for x in found] for k in ("cause", "summary_it", "summary_en")}, "day": f["day"]})

    rows = notes.select(*keep, "service_id", "outcome", "note", "day").mapInPandas(run, schema)
    return rows.select(*keep, "service_id", "outcome", "cause", "summary_it", "summary_en", iso_week(F.col("day")).alias("week"), F.lit(False).alias("simulated"))


def draft_fixes(groups: DataFrame, writer: Callable[[dict], str]) -> DataFrame:
    """Adds ``draft``: what ``writer`` makes of each group's row. Drafts wait for approval."""
    schema = T.StructType([*groups.schema.fields, T.StructField("draft", T.StringType()), T.StructField("approved", T.BooleanType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(draft=[writer(r) for r in f.to_dict("records")], approved=False)

    return groups.mapInPandas(run, schema)


def closure_rate(reports: DataFrame, *by: str) -> DataFrame:
    """The share of reports with outcome ``ok`` (design metric)."""
    return reports.groupBy(*by).agg(F.count("*").alias("n"), F.avg(F.col("outcome").eqNullSafe("ok").cast("double")).alias("closure_rate"))


def correction_effect(reports: DataFrame, corrections: DataFrame) -> DataFrame:
    """Per service, reports that went wrong before and since its correction (service_id, approved_at), by ``reported_on`` (design metric)."""
    joined = reports.join(corrections, "service_id").withColumn("wrong", ~F.col("outcome").eqNullSafe("ok"))
    before = F.col("reported_on") < F.col("approved_at")
    return joined.groupBy("service_id", "approved_at").agg(
        F.count_if(before & F.col("wrong")).alias("wrong_before"),
        F.count_if(before).alias("n_before"),
        F.count_if(~before & F.col("wrong")).alias("wrong_since"),
        F.count_if(~before).alias("n_since"),
        F.date_diff(F.first("approved_at"), F.min(F.when(F.col("wrong"), F.col("reported_on")))).alias("days_to_correct"),
    )
