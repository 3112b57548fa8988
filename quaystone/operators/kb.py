"""Queries of the knowledge base: services, case-specific checklists, nearest offices, sources."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaystone.functions import text as X
from quaystone.functions.geo import haversine_km

#: Said with every checklist, unless the caller gives another note.
NOTE = "not_yet_verified: no source has been checked for these. Say so, and refer to the official page."


def usable(status: Column, include_drafts: bool = False) -> Column:
    return status.eqNullSafe("verified") | F.lit(include_drafts)


def list_services(services: DataFrame) -> DataFrame:
    """id, title, verified_requirements, total_requirements."""
    requirements = F.coalesce("requirements", F.array().cast(services.schema["requirements"].dataType))
    verified = F.filter(requirements, lambda r: r["status"].eqNullSafe("verified"))
    return services.select("id", "title", F.size(verified).alias("verified_requirements"), F.size(requirements).alias("total_requirements"))


def get_service(services: DataFrame, service_id: str, include_drafts: bool = False) -> DataFrame:
    """One row, or none for an unknown id; only steps that may be shown."""
    steps = F.filter("steps", lambda s: usable(s["status"], include_drafts))
    return services.where(F.col("id") == service_id).select("id", "title", "ente", "deciding_questions", steps.alias("steps"), "unknowns_it").limit(1)


def bucket(when: Column, answers: Column, status: Column, include_drafts: bool = False) -> Column:
    """ask: a question of the condition is open; skip: an answer rules it out; unverified; applies. In this order."""
    keys = F.map_keys(answers)
    open_questions = F.filter(F.map_keys(when), lambda q: ~F.array_contains(keys, q))
    met = F.forall(F.map_entries(when), lambda e: F.coalesce(F.array_contains(e["value"], answers[e["key"]]), F.lit(False)))
    return F.when(F.coalesce(F.size(open_questions) > 0, F.lit(False)), "ask").when(~F.coalesce(met, F.lit(True)), "skip").when(~usable(status, include_drafts), "unverified").otherwise("applies")


def checklists(services: DataFrame, cases: DataFrame, sources: DataFrame, include_drafts: bool = False, note: str = NOTE) -> DataFrame:
    """A row for each case (case_id, service_id, answers map): requirements that apply in order, still_to_ask, not_yet_verified, sources, note.

    A question stays open even if another answer already rules the requirement out. A case of an unknown service has ``error`` set. Each case's
    requirements are sorted into buckets by array functions in its own row; only the sources cited are joined.
    """
    known = services.select(F.col("id").alias("service_id"), F.lit(True).alias("_known"), "requirements")
    joined = cases.join(known, "service_id", "left")
    answers = F.coalesce("answers", F.create_map().cast("map<string,string>"))
    of = lambda kind: F.filter("requirements", lambda r: bucket(r["when"], answers, r["status"], include_drafts) == kind)
    sorted_out = joined.select(
        "case_id",
        "service_id",
        "_known",
        F.transform(of("applies"), lambda r: F.struct(*(r[c].alias(c) for c in ("id", "text_it", "text_en", "source_id", "quote", "verified_at", "status")))).alias("requirements"),
        F.array_sort(F.array_distinct(F.flatten(F.transform(of("ask"), lambda r: F.filter(F.map_keys(r["when"]), lambda q: ~F.array_contains(F.map_keys(answers), q)))))).alias("still_to_ask"),
        F.transform(of("unverified"), lambda r: r["id"]).alias("not_yet_verified"),
    )
    cited = sorted_out.select(F.col("case_id").alias("_case"), F.col("service_id").alias("_service"), F.explode(F.array_distinct(F.transform("requirements", lambda r: r["source_id"]))).alias("cited"))
    found = cited.join(get_sources(sources), F.col("cited") == F.col("id"), "left")
    source = F.when(F.col("id").isNotNull(), F.struct("id", "title", "url", "publisher", "retrieved_at", "status"))
    per_case = found.groupBy("_case", "_service").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col("cited").alias("k"), source.alias("s")))), lambda x: x["s"]).alias("sources"))
    out = sorted_out.join(per_case, F.col("case_id").eqNullSafe(F.col("_case")) & F.col("service_id").eqNullSafe(F.col("_service")), "left")
    return out.select("case_id", "service_id", "requirements", "still_to_ask", "not_yet_verified", "sources", F.lit(note).alias("note"), F.when(F.col("_known").isNull(), F.concat(F.lit("Unknown service '"), "service_id", F.lit("'"))).alias("error"))


def get_checklist(services: DataFrame, sources: DataFrame, service_id: str, answers: dict[str, str] | None = None, include_drafts: bool = False) -> DataFrame:
    spark = services.sparkSession
    case = spark.createDataFrame([(1, service_id, answers or {})], "case_id long, service_id string, answers map<string,string>")
    return checklists(services, case, sources, include_drafts).drop("case_id")


def get_sources(sources: DataFrame) -> DataFrame:
    return sources.select("id", "title", "url", "publisher", "retrieved_at", "status")


def get_source(sources: DataFrame, source_id: str) -> DataFrame:
    """One row, or none."""
    return get_sources(sources).where(F.col("id") == source_id).limit(1)


def find_offices(offices: DataFrame, area: str | None = None, municipio: int | None = None, lat: float | None = None, lon: float | None = None, limit: int = 3, tie: str = "id") -> DataFrame:
    """Offices by district, area or distance. Each condition counts only if given; an empty area is none.

    ``distance_km`` is there only with both coordinates; distances are rounded before they are ordered, equal ones by ``tie``.
    """
    wanted = []
    if municipio is not None:
        wanted.append(F.col("municipio") == municipio)
    if area:
        wanted.append(X.contains_fold(F.col("nil.name"), F.lit(area)) | X.contains_fold(F.col("address"), F.lit(area)))
    found = offices.where(reduce(and_, wanted)) if wanted else offices
    keep = ["id", "municipio", "address", "entrance_note", "phone", "hours_it", "notes_it", "booking_without_spid", "nil", "source_id", "data_issues"]
    if lat is None or lon is None:
        return found.orderBy(tie).limit(limit).select(*(c for c in keep if c in found.columns))
    near = found.withColumn("distance_km", F.round(haversine_km(F.lit(lat), F.lit(lon), F.col("lat"), F.col("lon")), 2))
    return near.orderBy("distance_km", tie).limit(limit).select(*(c for c in keep if c in found.columns), "distance_km")


def index_lines(services: DataFrame, offices: DataFrame) -> DataFrame:
    """ordinal, id, line: what the knowledge base covers, a heading, a line a service and how many offices there are."""
    spark, none = services.sparkSession, F.lit(None).cast("string")
    counted = list_services(services)
    covered = F.format_string("- %s: %s (%d/%d requirements verified)", F.col("id"), F.col("title")["it"], F.col("verified_requirements"), F.col("total_requirements"))
    lines = counted.select(F.lit(1).alias("ordinal"), "id", covered.alias("line"))
    head = spark.createDataFrame([(0, None, "Services covered:")], "ordinal int, id string, line string")
    return head.union(lines).union(offices.agg(F.count("*").alias("n")).select(F.lit(2), none, F.format_string("Registry offices: %d.", F.col("n"))))


def index_text(services: DataFrame, offices: DataFrame) -> str:
    """The lines of a knowledge base that fits on a page."""
    return "\n".join(r["line"] for r in index_lines(services, offices).orderBy("ordinal", "id").collect())
