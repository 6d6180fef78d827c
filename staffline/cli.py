"""Command line: python -m staffline.cli parse|validate|export|info|geojson FILE..."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.settings import EngineConfig, class_by_name
from .operators import leveling as L
from .sinks import exports as X
from .sinks import reports
from .sources import instruments as I
from .sources.checkpoints import cut


def _loaded(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(setups, lines, totals, rejected) of the files; a line's id is the hash of its path."""
    files, missing = I.read_existing(spark, [str(Path(p).resolve()) for p in paths])
    s, ln, unknown = I.parse_files(files)
    key = F.xxhash64("path")
    s, ln = s.withColumn("line_id", key), ln.withColumns({"line_id": key, "is_used": F.lit(True), "line_date": F.lit(None).cast("timestamp")})
    s, ln = cut(s), cut(ln)  # parsed once for all that is printed
    totals = ln.select("line_id", "n_setups", F.col("total_distance").alias("distance"), F.col("total_height_diff").alias("height_diff"))
    return s, ln, totals, unknown.unionByName(missing)


def _show(rows: DataFrame, order: list[str], out) -> None:
    for r in rows.orderBy(*order).toLocalIterator():
        print(r.line, file=out)


def main(args: list[str], spark: SparkSession | None = None, out=None) -> int:
    """Exit code 0, or 1 if no file could be parsed. Texts go to out, the standard output if none is given."""
    out = out or sys.stdout
    p = argparse.ArgumentParser(prog="staffline")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("parse", "validate", "export", "info", "geojson"):
        c = sub.add_parser(name)
        c.add_argument("files", nargs="+")
        if name == "validate":
            c.add_argument("--class", dest="cls", default="H3")
            c.add_argument("--settings", default="")
        if name == "export":
            c.add_argument("-f", "--format", choices=("fa0", "fa1", "fteg", "rez", "all"), default="all")
        if name in ("export", "geojson"):
            c.add_argument("-o", "--output", default="project")
        if name == "geojson":
            c.add_argument("--coordinates", default="")
    a = p.parse_args(args)
    spark = spark or SparkSession.builder.getOrCreate()
    setups, lines, totals, rejected = _loaded(spark, a.files)
    for r in rejected.orderBy("path").toLocalIterator():
        print(f"skipped ({r['format']}): {r.path}", file=out)
    if lines.isEmpty():
        print("no line could be parsed", file=out)
        return 1
    bare = lines.drop("n_setups")
    if a.command == "parse":
        _show(reports.summary(bare, totals), ["section", "seq"], out)
    elif a.command == "info":
        r = reports.overview(bare, totals).first()
        print(f"Files: {r.n_files}, total distance: {r.total_distance:.2f} m", file=out)
    elif a.command == "validate":
        v = L.validate(bare, setups, class_by_name(a.cls), EngineConfig.load(a.settings) if a.settings else None)
        for r in v.join(bare.select("line_id", "filename"), "line_id").orderBy("filename").toLocalIterator():
            print(f"{r.filename}: " + ("valid" if r.valid else "; ".join(r.errors)) + (f" ({'; '.join(r.warnings)})" if r.warnings else ""), file=out)
        r = L.batch_summary(v).first()
        print(f"Valid: {r.valid} of {r.total} ({100 * r.pass_rate:.0f} %)", file=out)
    elif a.command == "export":
        obs = X.observations(bare, totals).withColumn("source_file", F.lit("")).join(bare.select(F.col("line_id").alias("obs_seq"), "filename"), "obs_seq").withColumn("source_file", F.col("filename")).drop("filename")
        marks = X.benchmarks_from_lines(bare).select("point_id", "height")
        for name in ("fa0", "fa1", "fteg", "rez") if a.format == "all" else (a.format,):
            to = f"{a.output}.{name}"
            if name == "fa0":
                X.write_text(X.fa0(obs, marks, to), to)
            elif name == "fteg":
                X.write_text(X.fteg(obs), to)
            elif name == "rez":
                X.write_text(X.rez(bare.join(totals, "line_id")), to, header=X.rez_header(a.output, ""))
            else:
                print("fa1 needs an adjustment: not written", file=out)
                continue
            print(f"written: {to}", file=out)
    else:
        ends = bare.select(F.explode(F.array("start_point", "end_point")).alias("point_id")).filter("point_id is not null")
        at = I.load_coordinates(spark, a.coordinates) if a.coordinates else X.schematic_coordinates(ends)
        X.write_geojson(X.geojson_lines(bare.join(totals, "line_id"), at), f"{a.output}.geojson")
        print(f"written: {a.output}.geojson", file=out)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
