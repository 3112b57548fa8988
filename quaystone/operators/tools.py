"""The knowledge base's tools: declarations, and dispatch by name. An error becomes a value, never an exception."""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quaystone.operators import kb

_TEXT = {"type": "string"}


def _tool(name: str, description: str, required: tuple[str, ...] = (), **properties: dict) -> dict:
    return {"name": name, "description": description, "input_schema": {"type": "object", "properties": properties, "required": list(required)}}


DECLARATIONS = [
    _tool("list_services", "Services covered, with how many requirements are verified."),
    _tool("get_service", "Deciding questions, steps and open points of a service.", ("service_id",), service_id=_TEXT),
    _tool("get_checklist", "What a case needs, from the answers known so far.", ("service_id",), service_id=_TEXT, answers={"type": "object", "additionalProperties": _TEXT}),
    _tool("find_offices", "Offices by area, district or distance.", (), area=_TEXT, municipio={"type": "integer", "minimum": 1, "maximum": 9}, lat={"type": "number"}, lon={"type": "number"}, limit={"type": "integer"}),
    _tool("get_source", "Where a fact comes from.", ("source_id",), source_id=_TEXT),
]


@dataclass
class KnowledgeBase:
    services: DataFrame
    offices: DataFrame
    sources: DataFrame
    include_drafts: bool = False

    def _rows(self, df: DataFrame) -> list[dict]:
        """Rows as JSON values. Small results by construction: a service, a few offices, a source."""
        return [json.loads(r["j"]) for r in df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j")).collect()]

    def run(self, name: str, arguments: dict) -> str:
        """The tool's result as JSON text."""
        try:
            if name == "list_services":
                out = self._rows(kb.list_services(self.services).orderBy("id"))
            elif name == "get_service":
                out = next(iter(self._rows(kb.get_service(self.services, arguments["service_id"], self.include_drafts))), {"error": "Unknown service_id"})
            elif name == "get_checklist":
                out = self._rows(kb.get_checklist(self.services, self.sources, arguments["service_id"], arguments.get("answers"), self.include_drafts))[0]
                out = {"error": out["error"]} if out["error"] else {k: v for k, v in out.items() if k != "error"}
            elif name == "find_offices":
                out = self._rows(kb.find_offices(self.offices, arguments.get("area"), arguments.get("municipio"), arguments.get("lat"), arguments.get("lon"), arguments.get("limit", 3)))
            elif name == "get_source":
                out = next(iter(self._rows(kb.get_source(self.sources, arguments["source_id"]))), {"error": "Unknown source_id"})
            else:
                out = {"error": f"Unknown tool {name}"}
        except Exception as e:
            out = {"error": f"{type(e).__name__}: {e}"}
        return json.dumps(out, ensure_ascii=False)


def answer_calls(calls: DataFrame, services: DataFrame, offices: DataFrame, sources: DataFrame, include_drafts: bool = False) -> DataFrame:
    """call_id, tool, result (JSON text): many calls (call_id, tool, arguments map) at once, each tool's by a join.

    As ``KnowledgeBase.run`` answers them one by one; ``find_offices`` here by district alone, the first three by id. Unknown ids, tools and
    missing arguments give a result with ``error``. Call ids are unique.
    """
    argument = lambda name: F.col("arguments")[name]
    said = lambda c: F.to_json(c, {"ignoreNullFields": "false"})
    error = lambda *text: F.to_json(F.struct(F.concat(*text).alias("error")))
    of = lambda tool: calls.where(F.col("tool") == tool)
    out = []

    def looked_up(tool: str, key: str, table: DataFrame) -> None:
        found = table.select(F.col("id").alias("_id"), F.struct(*table.columns).alias("_row"))
        joined = of(tool).join(found, argument(key) == F.col("_id"), "left")
        unknown = F.when(argument(key).isNull(), error(F.lit(f"missing argument {key}"))).otherwise(error(F.lit(f"Unknown {key}")))
        out.append(joined.select("call_id", "tool", F.when(F.col("_id").isNotNull(), said("_row")).otherwise(unknown).alias("result")))

    looked_up("get_source", "source_id", kb.get_sources(sources))
    steps = F.filter("steps", lambda s: kb.usable(s["status"], include_drafts))
    looked_up("get_service", "service_id", services.select("id", "title", "ente", "deciding_questions", steps.alias("steps"), "unknowns_it"))

    cases = of("get_checklist").select(F.col("call_id").alias("case_id"), argument("service_id").alias("service_id"), F.map_filter("arguments", lambda k, v: k != "service_id").alias("answers"))
    lists = kb.checklists(services, cases, sources, include_drafts)
    whole = said(F.struct(*(c for c in lists.columns if c not in ("case_id", "error"))))
    told = F.when(F.col("service_id").isNull(), error(F.lit("missing argument service_id"))).when(F.col("error").isNull(), whole).otherwise(error(F.col("error")))
    out.append(lists.select(F.col("case_id").alias("call_id"), F.lit("get_checklist"), told))

    few = Window.partitionBy("municipio").orderBy("id")
    firsts = offices.withColumn("_n", F.row_number().over(few)).where("_n <= 3").groupBy(F.col("municipio").cast("string").alias("_m")).agg(F.array_sort(F.collect_list(F.struct("id", "address", "phone"))).alias("_offices"))
    found = of("find_offices").join(firsts, argument("municipio") == F.col("_m"), "left")
    out.append(found.select("call_id", "tool", F.coalesce(said("_offices"), F.lit("[]"))))

    listed = kb.list_services(services).agg(F.array_sort(F.collect_list(F.struct("id", "title", "verified_requirements", "total_requirements"))).alias("_all"))  # what each such call gets
    out.append(of("list_services").join(F.broadcast(listed), F.lit(True)).select("call_id", "tool", said("_all")))
    known = [t["name"] for t in DECLARATIONS]
    out.append(calls.where(F.col("tool").isNull() | ~F.col("tool").isin(known)).select("call_id", "tool", error(F.lit("Unknown tool "), F.coalesce("tool", F.lit("null")))))
    return reduce(DataFrame.union, out)
