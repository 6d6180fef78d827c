"""Project storage: nested JSON documents of a project and flat tables; joint projects; audit log of removed lines."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .checkpoints import cut

SETUP = "setup_number int, from_point string, to_point string, backsight_reading double, foresight_reading double, distance_back double, distance_fore double, temperature double, height_diff double, is_used boolean"
LINE = f"filename string, start_point string, end_point string, method string, date string, instrument_id string, total_distance double, total_height_diff double, is_used boolean, original_direction string, setups array<struct<{SETUP}>>"
BENCHMARK = "point_id string, height double, order int, description string, easting double, northing double"
SCHEMA = f"name string, is_joint_project boolean, source_projects array<string>, created string, lines array<struct<{LINE}>>, benchmarks map<string, struct<{BENCHMARK}>>"


def line_documents(lines: DataFrame, setups: DataFrame) -> DataFrame:
    """lines with their setups nested in order, by line_id; a line is the unit, so no project is gathered whole."""
    of = [f.split()[0] for f in SETUP.split(", ")]
    nested = setups.groupBy("line_id").agg(F.array_sort(F.collect_list(F.struct(*of))).alias("setups"))
    return lines.join(nested, "line_id", "left").withColumn("setups", F.coalesce("setups", F.array()).cast(f"array<struct<{SETUP}>>"))


def load_json(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Project documents (one JSON object a file) under the explicit schema, with source path."""
    return spark.read.schema(SCHEMA).json(path, multiLine=True).withColumn("project_path", F.input_file_name())


def project_tables(projects: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lines, setups, benchmarks) of project documents; missing keys have their defaults and status is `valid`."""
    ln = projects.select(F.col("name").alias("project"), F.posexplode("lines").alias("line_seq", "l")).select("project", "line_seq", "l.*")
    flat = ln.select(
        "project", "line_seq", "filename", "start_point", "end_point", F.coalesce("method", F.lit("BF")).alias("method"), F.col("date").try_cast("timestamp").alias("line_date"), "instrument_id",
        F.coalesce("total_distance", F.lit(0.0)).alias("total_distance"), F.coalesce("total_height_diff", F.lit(0.0)).alias("total_height_diff"), F.coalesce("is_used", F.lit(True)).alias("is_used"),
        F.coalesce("original_direction", F.lit("BF")).alias("original_direction"), F.lit("valid").alias("status"),
    )
    setups = ln.select("project", "line_seq", F.inline("setups")).withColumn("is_used", F.coalesce("is_used", F.lit(True)))
    marks = projects.select(F.col("name").alias("project"), F.explode("benchmarks").alias("k", "b")).select("project", "b.*").withColumn("order", F.coalesce("order", F.lit(3)))
    return flat, setups, marks


def save_json(spark: SparkSession, path: str, name: str, lines: DataFrame, setups: DataFrame, benchmarks: DataFrame) -> None:
    """A directory of two JSON-lines tables: line documents and benchmarks; name is a column. Written in parallel."""
    line_documents(lines, setups).withColumn("project", F.lit(name)).write.mode("overwrite").json(f"{path}/lines", ignoreNullFields=False)
    benchmarks.withColumn("project", F.lit(name)).write.mode("overwrite").json(f"{path}/benchmarks", ignoreNullFields=False)


def load_saved(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lines, setups, benchmarks) of a directory that save_json wrote; every column that was saved."""
    raw = spark.read.json(f"{path}/lines")
    types = {f.name: f.dataType for f in raw.schema.fields}
    ln = spark.read.schema(", ".join(f"`{c}` {'array<struct<' + SETUP + '>>' if c == 'setups' else t.simpleString()}" for c, t in types.items())).json(f"{path}/lines")
    return ln.drop("setups"), ln.select("line_id", F.inline("setups")), spark.read.json(f"{path}/benchmarks")


def to_documents(lines: DataFrame, setups: DataFrame) -> DataFrame:
    """(line_id, document): each line with its setups as one JSON object."""
    docs = line_documents(lines, setups)
    return docs.select("line_id", F.to_json(F.struct(*(c for c in docs.columns if c != "line_id")), {"ignoreNullFields": "false"}).alias("document"))


def from_documents(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lines, setups) of `to_documents` rows."""
    parsed = cut(documents.select("line_id", F.from_json("document", LINE).alias("l")))
    return parsed.select("line_id", "l.*").drop("setups"), parsed.select("line_id", F.inline("l.setups"))


def save_document(path: str, name: str, lines: DataFrame, setups: DataFrame, benchmarks: DataFrame, created: str = "", source_projects: tuple[str, ...] = ()) -> None:
    """One JSON file of a project, as load_json reads it: its lines stream to the driver's file one at a time, in order of line_id."""
    head = {"name": name, "is_joint_project": bool(source_projects), "source_projects": list(source_projects), "created": created}
    with open(path, "w", encoding="utf-8") as f:
        f.write(json.dumps(head, ensure_ascii=False)[:-1] + ', "lines": [')
        for k, r in enumerate(to_documents(lines, setups).orderBy("line_id").toLocalIterator(prefetchPartitions=True)):
            f.write((",\n" if k else "\n") + r.document)
        f.write('], "benchmarks": {')
        fields = [c.split()[0] for c in BENCHMARK.split(", ")]
        own = benchmarks.select("point_id", F.to_json(F.struct(*(c for c in fields if c in benchmarks.columns)), {"ignoreNullFields": "false"}).alias("b"))
        for k, r in enumerate(own.orderBy("point_id").toLocalIterator(prefetchPartitions=True)):
            f.write(("," if k else "") + "\n" + json.dumps(r.point_id, ensure_ascii=False) + ": " + r.b)
        f.write("}}\n")


def project_properties(lines: DataFrame, setups: DataFrame, benchmarks: DataFrame, joint: bool = False) -> DataFrame:
    """One row: type, lines, used lines, benchmarks and distinct points of a project."""
    ends = lines.select(F.explode(F.array("start_point", "end_point")).alias("p"))
    points = ends.unionByName(setups.select(F.explode(F.array("from_point", "to_point")).alias("p"))).filter("p is not null").agg(F.countDistinct("p").alias("total_points"))
    n = lines.agg(F.count(F.lit(1)).alias("n_lines"), F.count_if("is_used").alias("n_used"))
    return n.crossJoin(benchmarks.agg(F.countDistinct("point_id").alias("n_benchmarks"))).crossJoin(points).select(F.lit("Joint Project" if joint else "Single Project").alias("type"), "*")  # one row each


def joint_lines(lines: DataFrame) -> DataFrame:
    """Lines of many projects (project_seq, line_seq) concatenated, none dropped; original_project keeps the source."""
    return lines.withColumn("original_project", F.col("project_seq"))


def joint_benchmarks(benchmarks: DataFrame) -> DataFrame:
    """One row per point: that of the first project that has it. Rows: point_id, project_seq and others."""
    rest = [c for c in benchmarks.columns if c not in ("point_id", "project_seq")]
    first = F.min_by(F.struct(*rest), F.struct("project_seq", *rest))
    return benchmarks.groupBy("point_id").agg(F.min("project_seq").alias("project_seq"), first.alias("b")).select("point_id", "project_seq", "b.*")


def list_projects(lines: DataFrame) -> DataFrame:
    """project, n_lines, n_used, total_distance (m) per project."""
    return lines.groupBy("project").agg(F.count(F.lit(1)).alias("n_lines"), F.count_if("is_used").alias("n_used"), F.sum("total_distance").alias("total_distance"))


def log_removed(removed: DataFrame, path: str, reason: str, at: str) -> None:
    """Appends filename, reason and time of removed lines to the audit table at path."""
    removed.select("filename", F.lit(reason).alias("reason"), F.lit(at).cast("timestamp").alias("removed_at")).write.mode("append").parquet(path)


def removed_report(log: DataFrame) -> DataFrame:
    """Per reason and file: times removed, first and last time, rank by last time within the reason."""
    g = log.groupBy("reason", "filename").agg(F.count(F.lit(1)).alias("times"), F.min("removed_at").alias("first_at"), F.max("removed_at").alias("last_at"))
    return g.withColumn("rank", F.row_number().over(Window.partitionBy("reason").orderBy(F.desc("last_at"), "filename")))
