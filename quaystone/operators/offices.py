"""Cleaning the office table: row-wise expressions from the raw CSV columns to the published shape, with its own list of issues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaystone.functions import text as X

#: What is said about a row's gaps.
ISSUES = {
    "title": "Campo 'titolo' vuoto: il Municipio della sede non è indicato",
    "phone": "Telefono mancante",
    "notes": "Nessuna nota su prenotazione e accesso",
    "entrance": "Ingresso indicato come provvisorio: verificare se è ancora valido",
    "date": "Il testo cita una data già passata (%s): informazione probabilmente non aggiornata",
}


def clean_offices(raw: DataFrame, as_of: Column, source_id: str = "ds549", ordinal: str = "ordinal") -> DataFrame:
    """Raw rows (with an ordinal from 1) to offices. Dates in the text count as past before ``as_of``."""
    address, entrance = X.seat_and_entrance(X.clean(F.col("Indirizzo")))
    row = raw.select(
        F.format_string(f"{source_id}-%02d", F.col(ordinal)).alias("id"),
        X.number_after(X.clean(F.col("titolo")), "Municipio").alias("municipio"),
        address.alias("address"),
        entrance.alias("entrance_note"),
        F.col("Indirizzo").alias("address_raw"),
        X.clean(F.col("telefono")).alias("_phone"),
        X.clean(F.col("orari")).alias("_hours"),
        X.clean(F.col("Note")).alias("_notes"),
        F.struct(F.col("ID_NIL").cast("int").alias("id"), X.clean(F.col("NIL")).alias("name")).alias("nil"),
        F.col("LAT_Y_4326").cast("double").alias("lat"),
        F.col("LONG_X_4326").cast("double").alias("lon"),
    )
    fixed = F.array(
        F.when(F.col("municipio").isNull(), ISSUES["title"]),
        F.when(F.col("_phone") == "", ISSUES["phone"]),
        F.when(F.col("_notes") == "", ISSUES["notes"]),
        F.when(X.contains_fold(F.col("entrance_note"), F.lit("provvisorio")), ISSUES["entrance"]),
    )
    dated = F.transform(X.past_dates(F.concat_ws(" ", "_hours", "_notes"), as_of), lambda d: F.format_string(ISSUES["date"], d))
    return row.select(
        "id",
        "municipio",
        "address",
        "entrance_note",
        "address_raw",
        X.or_null(F.replace(F.col("_phone"), F.lit("Infoline "), F.lit(""))).alias("phone"),
        X.or_null(F.col("_hours")).alias("hours_it"),
        X.or_null(F.col("_notes")).alias("notes_it"),
        X.true_if_says(F.col("_notes"), "esclusivamente su appuntamento").alias("appointment_only"),
        X.true_if_says(F.col("_notes"), "senza necessità di registrazione").alias("booking_without_spid"),
        "nil",
        "lat",
        "lon",
        F.lit(source_id).alias("source_id"),
        F.concat(F.filter(fixed, lambda x: x.isNotNull()), dated).alias("data_issues"),
    )


def flagged(offices: DataFrame) -> DataFrame:
    return offices.where(F.size("data_issues") > 0)
