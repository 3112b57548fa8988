"""Readers: CSV (fixed or sniffed), JSON arrays, folders of JSON documents, JSON lines, whole texts, CKAN and web pages.

All CSV columns are strings; casts are made where a value is used. Row order in small files is kept in an explicit ``ordinal``.
"""

from __future__ import annotations

import json
import os
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quaystone.sources.shared import local_path


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def read_csv(spark: SparkSession, path: str, sep: str = ",", schema: T.StructType | None = None, encoding: str = "UTF-8") -> DataFrame:
    """Header, quoted fields with doubled quotes, everything a string; an empty field is null."""
    reader = spark.read.options(header=True, sep=sep, quote='"', escape='"', multiLine=True, encoding=encoding)
    return (reader.schema(schema) if schema else reader).csv(path)


def sniff(spark: SparkSession, path: str) -> tuple[str, str]:
    """(encoding, separator): UTF-8 or else Windows-1252; ``;`` if the first line has more of them than commas."""
    raw = spark.read.format("binaryFile").load(path).select("content", F.expr("is_valid_utf8(content)").alias("valid"))
    row = raw.select("valid", F.substring("content", 1, 65536).alias("head")).first()
    encoding = "UTF-8" if row["valid"] else "windows-1252"
    line = bytes(row["head"]).decode("utf-8" if row["valid"] else "cp1252", "replace").split("\n", 1)[0]
    return encoding, ";" if line.count(";") > line.count(",") else ","


def read_csv_sniffed(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file of unknown encoding and separator. A byte-order mark isn't part of the first name.

    Spark 4 refuses Windows-1252: such a file is read as ISO-8859-1, and the characters that differ are replaced.
    """
    encoding, sep = sniff(spark, path)
    if encoding == "UTF-8":
        df = read_csv(spark, path, sep)
        return df.toDF(*(c.removeprefix("﻿") for c in df.columns))
    df = read_csv(spark, path, sep, encoding="ISO-8859-1")
    differ = {chr(i): bytes([i]).decode("cp1252", "replace") for i in range(0x80, 0xA0)}
    names = [c.translate(str.maketrans(differ)) for c in df.columns]
    return df.select(*(F.translate(F.col(f"`{c}`"), "".join(differ), "".join(differ.values())).alias(n) for c, n in zip(df.columns, names, strict=True)))


def read_csv_folder(spark: SparkSession, folder: str, register: bool = True) -> dict[str, DataFrame]:
    """Each CSV file of a folder by its stem, also as a temporary view of that name (``-`` becomes ``_``)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(folder).select("path").orderBy("path").collect()
    tables = {PurePosixPath(urllib.parse.unquote(r["path"])).stem: read_csv(spark, r["path"]) for r in files}
    if register:
        for name, df in tables.items():
            df.createOrReplaceTempView(name.replace("-", "_"))
    return tables


def read_json_array(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A file that holds one array of objects."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_json_documents(spark: SparkSession, folder: str, schema: T.StructType, key: str = "id", nested: bool = False) -> tuple[DataFrame, DataFrame]:
    """(documents, invalid files): one JSON object a file. Of documents with the same key the last file's stays.

    Invalid files don't stop the scan: they come back as (file, error). With ``nested``, the files of subfolders are read too, each subfolder
    by one task, and files go by their whole paths.
    """
    last = Window.partitionBy(key).orderBy(F.desc("file"))
    if nested:
        read, invalid = parse_json_documents(_document_texts(spark, folder), schema)
        return read.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n").select(*schema.names, "file"), invalid
    wide = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    read = spark.read.schema(wide).options(multiLine=True, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt", pathGlobFilter="*.json").json(folder)
    read = read.withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1))
    # a query of the corrupt column alone isn't allowed, so the key is looked at too
    invalid = read.where("_corrupt is not null").select("file", F.coalesce(F.concat(F.lit("invalid JSON near "), key), F.lit("invalid JSON")).alias("error"))
    good = read.where("_corrupt is null").drop("_corrupt").withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")
    return good, invalid


def _document_texts(spark: SparkSession, folder: str) -> DataFrame:
    """(file, content) of all ``*.json`` below a folder.

    Spark's file scan keeps every file's status on the driver and counts 4 MB for each, so that small files make very many tasks. Where Python
    can open the folder, the driver lists the subfolders alone, and a task lists and reads one of them.
    """
    root = local_path(spark, folder)
    if root is None:
        texts = spark.read.options(pathGlobFilter="*.json", recursiveFileLookup=True).text(folder, wholetext=True)
        return texts.select(F.input_file_name().alias("file"), F.col("value").alias("content"))
    hidden = lambda name: name.startswith(".") or name.startswith("_") and "=" not in name
    with os.scandir(root) as entries:
        subfolders = sorted(e.name for e in entries if e.is_dir() and not hidden(e.name))

    def fail(e: OSError) -> None:  # os.walk would leave out what it can't list
        raise e

    def files(at: str, deep: bool) -> Iterator[str]:
        for where, below, names in os.walk(at, onerror=fail):
            below[:] = [x for x in below if deep and not hidden(x)]
            yield from (f"{where}/{x}" for x in names if x.endswith(".json") and not hidden(x))

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found, size = [], 0
        for name in (x for frame in frames for x in frame["subfolder"]):
            for file in files(f"{root}/{name}".rstrip("/"), deep=name != ""):
                with open(file, "rb") as f:
                    found.append((file, f.read().decode("utf-8", "replace")))
                size += len(found[-1][1])
                if len(found) == 1000 or size > 2**22:
                    yield pd.DataFrame(found, columns=["file", "content"])
                    found, size = [], 0
        if found:
            yield pd.DataFrame(found, columns=["file", "content"])

    names = spark.sparkContext.parallelize([(x,) for x in ("", *subfolders)], 1 + len(subfolders))
    return spark.createDataFrame(names, "subfolder string").mapInPandas(read, "file string, content string")


def parse_json_documents(texts: DataFrame, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(documents, invalid): of (file, content), one JSON object a row. Rows whose content isn't one come back as (file, error); nulls too."""
    wide = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    parsed = texts.select("file", F.from_json("content", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("d"))
    wrong = F.col("d").isNull() | F.col("d._corrupt").isNotNull()
    return parsed.where(~wrong).select("file", "d.*").drop("_corrupt"), parsed.where(wrong).select("file", F.lit("invalid JSON").alias("error"))


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines; blank lines are skipped and a missing file is an empty table."""
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text), a row a file; bytes that aren't UTF-8 are replaced."""
    return spark.read.format("binaryFile").load(path).select("path", F.expr("coalesce(try_validate_utf8(cast(content as string)), make_valid_utf8(cast(content as string)))").alias("text"))


def with_ordinal(df: DataFrame, *order: str) -> DataFrame:
    """Number the rows from 1, in file order or by the columns given.

    Without columns, rows are numbered within each partition and shifted by the counts of those before it: only a count a partition goes
    to one task. By columns, a small table is ordered in one task.
    """
    if order:
        return df.withColumn("ordinal", F.row_number().over(Window.orderBy(*order)))
    at = df.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33))
    before = at.groupBy("_part").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return at.join(F.broadcast(before.select("_part", "_before")), "_part").withColumn("ordinal", (F.col("_before") + F.col("_at") - F.shiftleft("_part", 33) + 1).cast("int")).drop("_at", "_part", "_before")


Opener = Callable[[str], tuple[bytes, str]]


def open_url(url: str, timeout: float = 30) -> tuple[bytes, str]:
    """(body, charset): what the server names, UTF-8 otherwise."""
    with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": "Mozilla/5.0"}), timeout=timeout) as response:
        return response.read(), response.headers.get_content_charset() or "utf-8"


def ckan_csv(portal: str, package: str, opener: Opener = open_url) -> tuple[dict, bytes]:
    """(resource, bytes) of a CKAN package's first resource in CSV format. Runs on the driver."""
    body, charset = opener(f"{portal.rstrip('/')}/api/3/action/package_show?{urllib.parse.urlencode({'id': package})}")
    resources = json.loads(body.decode(charset))["result"]["resources"]
    chosen = next(r for r in resources if (r.get("format") or "").upper() == "CSV")
    return chosen, opener(chosen["url"])[0]


def fetch_page(url: str, opener: Opener = open_url) -> str:
    body, charset = opener(url)
    return body.decode(charset, "replace")


def url_status(df: DataFrame, url: str = "url", at_once: int = 8, status: Callable[[str], str] | None = None) -> DataFrame:
    """Adds ``link_status``: the HTTP status, or the error's text. Null and empty urls are not asked for (null)."""

    def ask(u: str) -> str:
        try:
            with urllib.request.urlopen(urllib.request.Request(u, headers={"User-Agent": "Mozilla/5.0"}), timeout=20) as r:
                return str(r.status)
        except urllib.error.HTTPError as e:
            return str(e.code)
        except Exception as e:  # an unreachable address is a result
            return f"error: {e}"

    asked = status or ask

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(at_once) as pool:
            for frame in frames:
                yield frame.assign(link_status=list(pool.map(lambda u: asked(u) if u else None, frame[url])))

    return df.mapInPandas(run, T.StructType([*df.drop("link_status").schema.fields, T.StructField("link_status", T.StringType())]))
