"""Open-data portals and web pages as data sources: ``spark.read.format("ckan")`` and ``format("webpages")`` after ``register(spark)``.

Tasks fetch the rows and pages; the driver asks a portal only how many rows there are and of which fields. A portal's table is read by offset and limit,
a part a task; equality filters go to the portal (with ``spark.sql.python.filterPushdown.enabled``). Requests are tried again, with growing
pauses, where another try may help.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition

#: Rows a request, tries, and seconds before the second try (then doubled).
PAGE_ROWS, TRIES, PAUSE, TIMEOUT = 10_000, 4, 0.5, 30
#: HTTP statuses after which another try may help.
AGAIN = {408, 425, 429, 500, 502, 503, 504}


def fetch(url: str, tries: int = TRIES, pause: float = PAUSE) -> tuple[bytes, str, int]:
    """(body, charset, status). Other statuses than AGAIN, and the last failure, are raised."""
    for left in range(tries, 0, -1):
        try:
            with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": "Mozilla/5.0"}), timeout=TIMEOUT) as r:
                return r.read(), r.headers.get_content_charset() or "utf-8", r.status
        except urllib.error.HTTPError as e:
            if e.code not in AGAIN or left == 1:
                raise
        except (urllib.error.URLError, TimeoutError, ConnectionError):
            if left == 1:
                raise
        time.sleep(pause)
        pause *= 2
    raise ValueError("no try was allowed")


def _asked(portal: str, action: str, **query) -> dict:
    body, charset, _ = fetch(f"{portal.rstrip('/')}/api/3/action/{action}?{urllib.parse.urlencode(query)}")
    found = json.loads(body.decode(charset))
    if not found.get("success", True):
        raise ValueError(f"{action}: {found.get('error')}")
    return found["result"]


#: How a portal names its types.
_KINDS = {"int": T.LongType(), "int4": T.LongType(), "int8": T.LongType(), "numeric": T.DoubleType(), "float8": T.DoubleType(), "bool": T.BooleanType()}
_MAKE = {"long": int, "integer": int, "double": float, "string": str, "boolean": lambda x: x if isinstance(x, bool) else str(x).lower() in ("true", "t", "1")}


class Part(InputPartition):
    def __init__(self, offset: int, rows: int):
        self.offset, self.rows = offset, rows


class CkanSource(DataSource):
    """Options: portal, and resource, or package (its first resource in CSV format); page_rows."""

    @classmethod
    def name(cls) -> str:
        return "ckan"

    def _resource(self) -> str:
        if "resource" not in self.options:
            listed = _asked(self.options["portal"], "package_show", id=self.options["package"])["resources"]
            self.options["resource"] = next(r["id"] for r in listed if (r.get("format") or "").upper() == "CSV")
        return self.options["resource"]

    def schema(self) -> T.StructType:
        fields = _asked(self.options["portal"], "datastore_search", resource_id=self._resource(), limit=0)["fields"]
        return T.StructType([T.StructField(f["id"], _KINDS.get(f.get("type", ""), T.StringType())) for f in fields])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return CkanReader(self.options["portal"], self._resource(), schema, int(self.options.get("page_rows", PAGE_ROWS)))


class CkanReader(DataSourceReader):
    def __init__(self, portal: str, resource: str, schema: T.StructType, page_rows: int):
        self.portal, self.resource, self.schema, self.page_rows, self.equal = portal, resource, schema, page_rows, {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """The portal looks for equal values of plain columns; Spark keeps the rest."""
        for f in filters:
            if isinstance(f, EqualTo) and len(f.attribute) == 1 and f.attribute[0] not in self.equal and isinstance(f.value, (str, int, bool)):
                self.equal[f.attribute[0]] = f.value
            else:
                yield f

    def _query(self, offset: int, limit: int) -> dict:
        query = {"resource_id": self.resource, "offset": offset, "limit": limit, "sort": "_id"} | ({"filters": json.dumps(self.equal)} if self.equal else {})
        return _asked(self.portal, "datastore_search", **query)

    def partitions(self) -> list[InputPartition]:
        total = self._query(0, 0)["total"]
        return [Part(a, min(self.page_rows, total - a)) for a in range(0, total, self.page_rows)] or [Part(0, 0)]

    def read(self, partition: Part) -> Iterator[tuple]:
        """A portal may give fewer rows a request than asked for: the rest is asked for again."""
        at, end = partition.offset, partition.offset + partition.rows
        make = [(f.name, _MAKE[f.dataType.typeName()]) for f in self.schema]
        while at < end:
            records = self._query(at, end - at)["records"]
            if not records:
                raise ValueError(f"{self.resource} has no rows from {at} on any more: it changed while it was read")
            for r in records:
                yield tuple(None if r.get(n) is None else m(r[n]) for n, m in make)
            at += len(records)


class Urls(InputPartition):
    def __init__(self, urls: list[str]):
        self.urls = urls


class PageSource(DataSource):
    """Option urls (separated by line ends), urls_a_task: url, status (a number or an error's text), body."""

    @classmethod
    def name(cls) -> str:
        return "webpages"

    def schema(self) -> str:
        return "url string, status string, body string"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        urls = list(dict.fromkeys(u.strip() for u in self.options.get("urls", "").splitlines() if u.strip()))
        return PageReader(urls, int(self.options.get("urls_a_task", 4)))


class PageReader(DataSourceReader):
    def __init__(self, urls: list[str], a_task: int):
        self.urls, self.a_task = urls, a_task

    def partitions(self) -> list[InputPartition]:
        return [Urls(self.urls[a : a + self.a_task]) for a in range(0, len(self.urls), self.a_task)] or [Urls([])]

    def read(self, partition: Urls) -> Iterator[tuple]:
        for url in partition.urls:
            try:
                body, charset, status = fetch(url)
                yield url, str(status), body.decode(charset, "replace")
            except urllib.error.HTTPError as e:
                yield url, str(e.code), None
            except Exception as e:  # an unreachable page is a row
                yield url, f"error: {e}", None


def register(spark: SparkSession) -> None:
    spark.dataSource.register(CkanSource)
    spark.dataSource.register(PageSource)
