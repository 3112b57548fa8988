"""Explicit schemas of the entities. Inference would turn the ``when`` map into a struct, so none is inferred."""

from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


STRING, INT, DOUBLE, BOOL = T.StringType(), T.IntegerType(), T.DoubleType(), T.BooleanType()
STRINGS = T.ArrayType(STRING)

SOURCE = _struct(id=STRING, title=STRING, url=STRING, publisher=STRING, kind=STRING, snapshot=STRING, retrieved_at=STRING, status=STRING, notes=STRING)
QUESTION = _struct(id=STRING, ask_it=STRING, ask_en=STRING, options=STRINGS, kind=STRING)
REQUIREMENT = _struct(id=STRING, text_it=STRING, text_en=STRING, when=T.MapType(STRING, STRINGS), source_id=STRING, quote=STRING, verified_at=T.DateType(), status=STRING)
STEP = _struct(order=INT, ente=STRING, text_it=STRING, source_id=STRING, quote=STRING, verified_at=T.DateType(), status=STRING)
SERVICE = _struct(id=STRING, title=_struct(it=STRING, en=STRING), ente=STRING, summary_it=STRING, source_ids=STRINGS, deciding_questions=T.ArrayType(QUESTION), requirements=T.ArrayType(REQUIREMENT), steps=T.ArrayType(STEP), unknowns_it=STRINGS)
OFFICE = _struct(id=STRING, municipio=INT, address=STRING, entrance_note=STRING, address_raw=STRING, phone=STRING, hours_it=STRING, notes_it=STRING, appointment_only=BOOL, booking_without_spid=BOOL, nil=_struct(id=INT, name=STRING), lat=DOUBLE, lon=DOUBLE, source_id=STRING, data_issues=STRINGS)
BODY = _struct(id=STRING, name=STRING, role_it=STRING, source_ids=STRINGS, status=STRING)
REPORT = _struct(service_id=STRING, outcome=STRING, cause=STRING, summary_it=STRING, summary_en=STRING, week=STRING, simulated=BOOL)
#: A report with the time of its arrival, for streams.
REPORT_EVENT = T.StructType([*REPORT.fields, T.StructField("reported_at", T.TimestampType())])
RAW_OFFICE = _struct(titolo=STRING, Indirizzo=STRING, telefono=STRING, orari=STRING, Note=STRING, ID_NIL=STRING, NIL=STRING, LONG_X_4326=STRING, LAT_Y_4326=STRING, Location=STRING)
PAGE_SNAPSHOT = _struct(source_id=STRING, url=STRING, retrieved_at=STRING, html_sha256=STRING, text=STRING)
CAUSE = _struct(cause=STRING, cause_label=STRING, recipient=STRING)

#: Causes of reports, their labels and who is told.
CAUSES = [
    ("pagina-incompleta", "Page incomplete", "Web editors (redazione web)"),
    ("procedura-non-aggiornata", "Procedure out of date", "Office that owns the procedure"),
    ("procedura-mancante", "No page for this case", "Office that owns the procedure, and web editors"),
    ("ufficio-sbagliato", "Wrong body or office indicated", "Web editors (redazione web)"),
    ("non-seguita", "Page was clear, not followed", "Nobody: improve the assistant"),
    ("richiesta-non-prevista", "Desk asked for something the procedure doesn't require", "Head of service, per procedure and per office"),
]
