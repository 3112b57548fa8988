"""Constraint checks over the knowledge base as one table of violations: rule, severity, place, message.

The chain of a fact's checks stops early: an unknown source or a status other than verified ends it; then the date and the
quote are looked at independently.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from quaystone.functions import text as X
from quaystone.functions.dates import is_stale

STALE_DAYS = 90


def _violation(df: DataFrame, rule: str, severity: str, place: Column, message: Column) -> DataFrame:
    return df.select(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), place.alias("place"), message.alias("message"))


def duplicates(df: DataFrame, key: list[str], ordinal: str) -> DataFrame:
    """Every further row of a key, in the order of ``ordinal`` (which is unique within a key; nulls are one key).

    The first ordinal of each key is aggregated before the shuffle, and the join is by key and ordinal: a key that very many rows share
    is spread over all tasks.
    """
    first = df.groupBy(*(F.col(k).alias(f"_key{i}") for i, k in enumerate(key))).agg(F.min(ordinal).alias("_first"))
    same = F.col(ordinal) == F.col("_first")
    for i, k in enumerate(key):
        same &= F.col(k).eqNullSafe(F.col(f"_key{i}"))
    return df.join(first, same, "left_anti")


def facts(services: DataFrame) -> DataFrame:
    """Requirements and steps as one table, in one scan: place, status (absent: todo), source_id, quote, verified_at."""
    name = F.coalesce("file", F.col("id")) if "file" in services.columns else F.col("id")

    def parts(column: str, label: str, key: str) -> Column:
        place = lambda x: F.concat(name, F.lit(f" {label} '"), F.coalesce(x[key].cast("string"), F.lit("null")), F.lit("'"))
        fact = lambda x: F.struct(place(x).alias("place"), F.coalesce(x["status"], F.lit("todo")).alias("status"), x["source_id"].alias("source_id"), x["quote"].alias("quote"), x["verified_at"].alias("verified_at"))
        found = F.transform(column, fact)
        return F.coalesce(found, F.slice(F.array(fact(F.lit(None).cast(services.schema[column].dataType.elementType))), 1, 0))

    return services.select(F.explode(F.concat(parts("requirements", "requirement", "id"), parts("steps", "step", "order"))).alias("x")).select("x.*")


def status_counts(services: DataFrame) -> DataFrame:
    return facts(services).groupBy("status").agg(F.count("*").alias("n"))


def _told(rule: str, severity: str, holds: Column, place: Column, message: Column) -> Column:
    """A violation where the condition holds, else null: rules over the same rows stand side by side in one array."""
    return F.when(holds, F.struct(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), place.alias("place"), message.alias("message")))


def _violations(rows: DataFrame, *rules: Column) -> DataFrame:
    return rows.select(F.explode(F.filter(F.array(*rules), lambda v: v.isNotNull())).alias("v")).select("v.*")


def source_checks(sources: DataFrame, snapshots: DataFrame) -> DataFrame:
    """V1-V3. sources need an ordinal; snapshots are (path, text), paths as the sources give them.

    Each id's first and last ordinals are aggregated and joined back, so an id that very many rows share is spread; all three rules are
    looked at in one pass over the joined rows. A null id is like any other.
    """
    ends = sources.groupBy(F.col("id").alias("_id")).agg(F.min("ordinal").alias("_first"), F.max("ordinal").alias("_last"))
    there = snapshots.select(F.col("path").alias("_path")).distinct()
    rows = sources.join(ends, F.col("id").eqNullSafe(F.col("_id"))).join(there, F.col("snapshot") == F.col("_path"), "left")
    place, last, unnamed = F.concat(F.lit("sources: "), "id"), F.col("ordinal") == F.col("_last"), X.is_missing(F.col("snapshot"))
    return _violations(
        rows,
        _told("V1", "ERROR", F.col("ordinal") > F.col("_first"), place, F.lit("duplicate id")),
        _told("V2", "ERROR", last & ~unnamed & F.col("_path").isNull(), place, F.concat(F.lit("snapshot "), "snapshot", F.lit(" not found"))),
        _told("V3", "WARN", last & unnamed & ~F.col("status").eqNullSafe("todo"), place, F.lit("no snapshot saved")),
    )


def fact_checks(found: DataFrame, sources: DataFrame, snapshots: DataFrame, as_of: Column, stale_days: int = STALE_DAYS) -> DataFrame:
    """V4-V9 in one pass: facts meet their source and its normalised snapshot once, and each row tells all that it violates.

    The quote is compared with its own source's snapshot only. Texts are normalised before the join, once each, and shuffled once.
    """
    last = sources.groupBy("id").agg(F.max_by("snapshot", "ordinal").alias("snapshot"))
    texts = snapshots.select(F.col("path").alias("snapshot"), X.normalise(F.col("text")).alias("saved"))
    known = last.join(texts, "snapshot", "left").select(F.col("id").alias("source_id"), F.lit(True).alias("known"), "saved")
    rows, at = found.join(known, "source_id", "left"), F.col("place")
    verified = F.col("known") & (F.col("status") == "verified")
    unquoted = X.is_missing(F.col("quote"))
    return _violations(
        rows,
        _told("V4", "ERROR", F.col("known").isNull(), at, F.concat(F.lit("unknown source_id '"), F.coalesce("source_id", F.lit("null")), F.lit("'"))),
        _told("V5", "ERROR", verified & F.col("verified_at").isNull(), at, F.lit("verified but no date")),
        _told("V6", "WARN", verified & is_stale(F.col("verified_at"), as_of, stale_days), at, F.lit(f"verified more than {stale_days} days ago")),
        _told("V7", "ERROR", verified & unquoted, at, F.lit("verified but no quote")),
        _told("V8", "ERROR", verified & ~unquoted & F.col("saved").isNull(), at, F.concat(F.lit("no saved snapshot of "), "source_id")),
        _told("V9", "ERROR", verified & ~unquoted & ~F.contains("saved", X.normalise(F.col("quote"))), at, F.concat(F.lit("quote not in the saved source: "), F.substring("quote", 1, 80))),
    )


#: Bytes of quotes that one automaton is made of: what is collected and broadcast at a time.
AUTOMATON_BYTES = 16 << 20


def ground_quotes(quotes: DataFrame, texts: DataFrame) -> DataFrame:
    """(quote_id, text_id) of all texts that hold a quote, after normalisation of both; null quotes and texts hold nothing.

    Quotes are dealt by hash into blocks of about AUTOMATON_BYTES. A block becomes one automaton that a task runs over its texts, whatever
    the lengths of the quotes, so a text is read once a block, never shuffled, and meets no quote that it doesn't hold. An empty quote is in each text.
    """
    q = quotes.where("quote is not null").select("quote_id", X.normalise(F.col("quote")).alias("quote"))
    t = texts.where("text is not null").select("text_id", X.normalise(F.col("text")).alias("text"))
    schema = T.StructType([T.StructField("quote_id", q.schema["quote_id"].dataType), T.StructField("text_id", t.schema["text_id"].dataType)])
    size = q.agg(F.sum(F.octet_length("quote") + 16)).first()[0] or 0
    blocks = -(-size // AUTOMATON_BYTES)
    if not blocks:
        return t.sparkSession.createDataFrame([], schema)
    return reduce(DataFrame.union, (_held(q.where(F.pmod(F.xxhash64("quote_id", "quote"), F.lit(blocks)) == b), t, schema) for b in range(blocks)))


def _held(block: DataFrame, texts: DataFrame, schema: T.StructType) -> DataFrame:
    """The pairs of one block of quotes, whose bytes are bounded."""
    by_text: dict[str, list] = {}
    for r in block.collect():
        by_text.setdefault(r["quote"], []).append(r["quote_id"])
    sent = texts.sparkSession.sparkContext.broadcast(by_text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton, everywhere = ahocorasick.Automaton(), sent.value.get("", [])
        for quote, ids in sent.value.items():
            if quote:
                automaton.add_word(quote, ids)
        automaton.make_automaton()
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                some = batch.slice(a, 500)
                ids, owners = [], []
                for i, text in enumerate(some.column(1).to_pylist()):
                    lists = {id(x): x for _, x in automaton.iter(text)} if len(automaton) else {}
                    for found in (*lists.values(), everywhere):
                        ids += found
                        owners += [i] * len(found)
                yield pa.RecordBatch.from_arrays([pa.array(ids, kinds[0]), some.column(0).take(pa.array(owners, pa.int32()))], names=schema.names)

    kinds = [to_arrow_type(f.dataType) for f in schema]
    return texts.select("text_id", "text").mapInArrow(run, schema)


def service_checks(services: DataFrame, invalid: DataFrame) -> DataFrame:
    """V10-V14. services need a column ``file``; invalid is (file, error). A service's rules are looked at in its own row, in one scan."""
    v10 = _violation(invalid, "V10", "ERROR", F.col("file"), F.col("error"))
    file, kind = F.col("file"), services.schema["deciding_questions"].dataType
    text = lambda *parts: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in parts))
    named = lambda r: F.coalesce(r["id"], F.lit("null"))
    place = lambda r: text(file, " requirement '", named(r), "'")
    missing = [_told("V11", "ERROR", F.col(c).isNull(), file, F.lit(f"missing '{c}'")) for c in ("id", "title", "deciding_questions", "requirements")]
    listed = F.col("requirements")
    key = lambda r: F.coalesce(F.concat(F.lit("="), r["id"]), F.lit(""))
    again = F.transform(listed, lambda r, i: _told("V12", "ERROR", F.array_position(F.transform(listed, key), key(r)) <= i, place(r), F.lit("duplicate id")))

    def asked(r: Column) -> Column:
        """V13 and V14 of each condition of a requirement."""

        def one(entry: Column) -> Column:
            q, allowed = entry["key"], entry["value"]
            same = F.filter(F.coalesce("deciding_questions", F.array().cast(kind)), lambda x: x["id"] == q)
            question = F.get(same, F.size(same) - 1)  # the last of that id
            outside = question["options"].isNotNull() & (F.size(F.array_except(allowed, question["options"])) > 0)
            return F.coalesce(
                _told("V13", "ERROR", question.isNull(), place(r), text("'when' uses unknown question '", q, "'")),
                _told("V14", "ERROR", outside, place(r), text("'when' values ", F.array_join(allowed, ", "), " not in the options of '", q, "'")),
            )

        return F.transform(F.map_entries(r["when"]), one)

    conditions = F.flatten(F.filter(F.transform(listed, asked), lambda x: x.isNotNull()))
    none = F.filter(F.array(missing[0]), lambda v: F.lit(False))
    found = F.concat(F.array(*missing), F.coalesce(again, none), F.coalesce(conditions, none))
    rest = services.select(F.explode(F.filter(found, lambda v: v.isNotNull())).alias("v")).select("v.*")
    return v10.union(rest)


def link_checks(checked: DataFrame) -> DataFrame:
    """V15, from a table with ``link_status`` (see readers.url_status)."""
    bad = checked.where(F.col("link_status").isNotNull() & (F.col("link_status") != "200"))
    return _violation(bad, "V15", "WARN", F.concat(F.lit("link "), "id"), F.concat("url", F.lit(" -> "), "link_status"))


def office_checks(offices: DataFrame) -> DataFrame:
    """V16: a row for each issue of an office."""
    return _violation(offices.select("id", F.explode("data_issues").alias("issue")), "V16", "DATA", F.col("id"), F.col("issue"))


def validate(sources: DataFrame, snapshots: DataFrame, services: DataFrame, invalid: DataFrame, as_of: Column, offices: DataFrame | None = None) -> DataFrame:
    out = source_checks(sources, snapshots).union(fact_checks(facts(services), sources, snapshots, as_of)).union(service_checks(services, invalid))
    return out.union(office_checks(offices)) if offices is not None else out
