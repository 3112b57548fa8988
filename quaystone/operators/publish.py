"""What may be published: cubes whose small cells can't be computed from their totals, sketches that merge, layers without free text."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

THRESHOLD = 5


def outcome_cube(reports: DataFrame, dims: list[str], ok: Column) -> DataFrame:
    """dims..., level, n, n_ok for every combination of dimensions: ``level`` is the grouping id (a bit is 1 where the dimension is summed over).

    One scan; partial counts are made before the shuffle. A null value is a value of its own, told from a total by ``level``.
    """
    marked = reports.select(*dims, ok.cast("boolean").alias("_ok"))
    return marked.cube(*dims).agg(F.grouping_id().cast("int").alias("level"), F.count("*").alias("n"), F.count_if("_ok").alias("n_ok"))


def _groups(cube: DataFrame, dims: list[str], i: int) -> DataFrame:
    """_v (a value of dimension i), _g: values in groups of two or three of like size; the largest is in group 0, with the total."""
    single = (1 << len(dims)) - 1 - (1 << (len(dims) - 1 - i))
    one = cube.where(F.col("level") == single).select(F.col(dims[i]).alias("_v"), "n")
    ranked = one.withColumn("_r", F.row_number().over(Window.orderBy(F.desc("n"), "_v")) - 1)  # a row a value of one dimension
    last = F.max("_r").over(Window.partitionBy())
    group = F.floor((F.col("_r") + 1) / 2)
    alone = (F.col("_r") == last) & (F.col("_r") % 2 == 1)  # an odd rank begins a group: as the last it would stand alone
    return ranked.select("_v", F.when(alone, group - 1).otherwise(group).cast("int").alias("_g"))


def withheld_cells(cube: DataFrame, dims: list[str], threshold: int = THRESHOLD) -> DataFrame:
    """The cube with ``withheld``: small cells, and with each the others that hide it.

    Each dimension's values, with its total as one more, fall into groups of two or three; the total's group has a value, any other at
    least two. A block is the product of a group of each dimension; if one of its cells is below the threshold, all are withheld. So
    whatever the cell, each dimension offers a way of changing it and another of its group that leaves every sum of that dimension as it is (one
    up, the other down; or a value and the total, both up), and their product changes withheld cells only: no system of sums over the
    published cells determines a withheld one. (What is known of a sum still bounds its parts.) Values of like size share
    groups, so that small cells hide each other and few large ones go with them.
    """
    out = cube
    for i, d in enumerate(dims):
        total = F.col("level").bitwiseAND(1 << (len(dims) - 1 - i)) != 0
        g = _groups(cube, dims, i)
        out = out.join(g, ~total & F.col(d).eqNullSafe(F.col("_v")), "left").withColumn(f"_g{i}", F.when(total, 0).otherwise(F.col("_g"))).drop("_v", "_g")
    block = [f"_g{i}" for i in range(len(dims))]
    small = F.max(F.col("n") < threshold).over(Window.partitionBy(*block))  # 3^dimensions cells at most
    return out.withColumn("withheld", small).drop(*block)


def published_cube(reports: DataFrame, dims: list[str], ok: Column, threshold: int = THRESHOLD) -> DataFrame:
    """dims..., level, n, closure_rate: the cells that may be seen. Withheld ones have no row, as empty ones have none."""
    shown = withheld_cells(outcome_cube(reports, dims, ok), dims, threshold).where(~F.col("withheld"))
    return shown.select(*dims, "level", "n", F.round(F.col("n_ok") / F.col("n"), 6).alias("closure_rate"))


# Sketches

#: Standard errors: of the distinct count 1.04 / sqrt(2^LOG_SIZE); of a percentile's rank about 2.3 / K^0.9 (both of the sketches' authors).
LOG_SIZE, K = 12, 400
DISTINCT_ERROR, RANK_ERROR = 1.04 / 2 ** (LOG_SIZE / 2), 2.296 / K**0.9021


def day_sketches(rows: DataFrame, day: str, by: list[str], distinct: str, value: str) -> DataFrame:
    """day, by..., n, distinct_sketch, value_sketch: one row a day and group. A task sends a sketch a group, not its rows.

    Nulls are in neither sketch; ``value`` is taken as a double.
    """
    return rows.groupBy(F.to_date(day).alias("day"), *by).agg(F.count("*").alias("n"), F.hll_sketch_agg(distinct, LOG_SIZE).alias("distinct_sketch"), F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(K)).alias("value_sketch"))


def store_sketches(rows: DataFrame, path: str, day: str, by: list[str], distinct: str, value: str) -> None:
    """Write the sketches of the days in ``rows``, a folder a day; days that are there already are replaced, the others aren't touched."""
    sketches = day_sketches(rows, day, by, distinct, value)
    sketches.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def merged_sketches(sketches: DataFrame, by: list[str], percentiles: Iterable[float] = (0.5, 0.9)) -> DataFrame:
    """by..., n, n_distinct, percentiles (array) over all days of stored sketches; the rows themselves aren't read again."""
    united = sketches.groupBy(*by).agg(F.sum("n").alias("n"), F.hll_sketch_estimate(F.hll_union_agg("distinct_sketch")).alias("n_distinct"), F.kll_merge_agg_double("value_sketch").alias("_kll"))
    at = [F.kll_sketch_get_quantile_double("_kll", F.lit(float(p))) for p in percentiles]
    return united.select(*by, "n", "n_distinct", F.when(F.kll_sketch_get_n_double("_kll") > 0, F.array(*at)).alias("percentiles"))


# Layers


class FreeText(ValueError):
    """A column that may not leave a layer derives from free text."""


def sources_of(df: DataFrame) -> dict[str, set[str]]:
    """For each column of ``df``, the names of the columns of its tables that it derives from, however renamed.

    Read from the analysed plan as Spark gives it to query listeners: expressions' references are followed down to relations, filters and join
    conditions not counted.
    """
    plan = df._jdf.queryExecution().analyzed()
    known: dict[int, set[str]] = {}

    def each(seq):
        it = seq.iterator()
        while it.hasNext():
            yield it.next()

    def of(refs) -> set[str]:
        return set().union(*(known.get(r.exprId().id(), set()) for r in each(refs)))

    def walk(node) -> None:
        for child in each(node.children()):
            walk(child)
        outputs = list(each(node.output()))
        if not node.children().size():
            known.update({a.exprId().id(): {a.name()} for a in outputs})
            return
        if node.nodeName() == "Union":
            for child in each(node.children()):
                for a, b in zip(outputs, each(child.output()), strict=True):
                    known.setdefault(a.exprId().id(), set()).update(known.get(b.exprId().id(), set()))
            return
        fresh = [a for a in outputs if a.exprId().id() not in known]
        if not fresh:
            return
        named = {e.exprId().id(): of(e.references().toSeq()) for e in each(node.expressions()) if e.getClass().getSimpleName() == "Alias"}
        whole = of(node.references().toSeq())  # generators, Python functions and the like make all they read
        known.update({a.exprId().id(): named.get(a.exprId().id(), whole) for a in fresh})

    walk(plan)
    return {a.name(): known.get(a.exprId().id(), set()) for a in each(plan.output())}


def published_layer(df: DataFrame, free_text: set[str]) -> DataFrame:
    """``df``, if none of its columns derives from one of the free-text columns of its tables; else FreeText."""
    wrong = {c: sorted(s & free_text) for c, s in sources_of(df).items() if s & free_text}
    if wrong:
        raise FreeText(f"derived from free text: {wrong}")
    return df


def pseudonym(value: Column, keys: dict[int, str], version: int) -> Column:
    """``version:digest``: a keyed pseudonym (HMAC-SHA256 by the version's key); null stays null. Rotate by adding a version to ``keys``.

    Pseudonyms of one version are equal for equal values and can't be linked with another version's without its key.
    """
    key = keys[version].encode()
    key = hashlib.sha256(key).digest() if len(key) > 64 else key
    pad = lambda x: F.unhex(F.lit(bytes(b ^ x for b in key.ljust(64, b"\0")).hex()))
    inner = F.unhex(F.sha2(F.concat(pad(0x36), value.cast("string").cast("binary")), 256))
    return F.concat(F.lit(f"{version}:"), F.sha2(F.concat(pad(0x5C), inner), 256))


def pseudonym_in(stored: Column, value: Column, keys: dict[int, str]) -> Column:
    """Whether ``stored`` is the pseudonym of ``value`` under the version that it names; false where that key is gone."""
    tests = [F.when(F.startswith(stored, F.lit(f"{v}:")), stored == pseudonym(value, {v: k}, v)) for v, k in keys.items()]
    return F.coalesce(*tests, F.lit(False)) if tests else F.lit(False)


LAYERS = ("received", "classified", "grouped", "published")


class Layers:
    """Four folders of Parquet tables, each a layer further from what people wrote; all but the last are partitioned by day.

    received: notes as they came; classified: causes and pseudonyms, no note; grouped: counts; published: cells that may be seen. A write to
    any layer after the first is refused if a column derives from free text, whatever it is called.
    """

    def __init__(self, spark: SparkSession, folder: str, free_text: set[str]):
        self.spark, self.folder, self.free_text = spark, folder.rstrip("/"), free_text

    def path(self, layer: str) -> str:
        return f"{self.folder}/{LAYERS.index(layer) + 1}_{layer}"

    def write(self, layer: str, df: DataFrame) -> None:
        """Days that ``df`` holds replace those of the layer; the published layer is replaced whole."""
        checked = df if layer == LAYERS[0] else published_layer(df, self.free_text)
        if layer == LAYERS[-1]:
            checked.write.mode("overwrite").parquet(self.path(layer))
        else:
            checked.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(self.path(layer))

    def read(self, layer: str) -> DataFrame:
        return self.spark.read.parquet(self.path(layer))

    def expire(self, layer: str, before: str) -> list[str]:
        """Remove whole days before a date, without reading a row; the days that went."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path(layer))
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        gone = sorted(d for d in (s.getPath().getName() for s in fs.listStatus(path)) if d.startswith("day=") and d[4:] < before)
        for d in gone:
            fs.delete(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path, d), True)
        return [d[4:] for d in gone]
