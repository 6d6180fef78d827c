"""Instrument files: format detection, decoding, Trimble DAT and Leica GSI parsers, and text rendered from setups.

A file is one record of `files` (path, text); its lines are exploded and the parsers' running state (last backsight,
its distance, temperature) is carried by windows over the file's lines, so a parse is one shuffle on path.
Parsers return (setups, lines); a number that can't be read makes its file a row with status `parse_error`.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import regulations as R

#: fixed values: encodings in the order in which they're tried
ENCODINGS = ("cp1255", "utf-8", "latin-1")
_BLANK = " \t\r\n\f\v"
_READING, _DIST, _HEIGHT = "decimal(12,5)", "decimal(12,3)", "decimal(14,5)"


def decode(content: Column) -> Column:
    """Bytes to text by the first encoding that fits; the last one fits always. Null stays null."""

    @F.pandas_udf("string")
    def cascade(raw: pd.Series) -> pd.Series:
        def one(b):
            for enc in ENCODINGS:
                try:
                    return bytes(b).decode(enc)
                except UnicodeDecodeError:
                    pass

        return raw.map(one, na_action="ignore")

    return cascade(content)


def read_files(spark: SparkSession, paths: str | list[str], glob: str = "*.{DAT,dat,RAW,raw,GSI,gsi}") -> DataFrame:
    """(path, text, format) of each instrument file below the paths, once per path."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(paths).select("path", "content").dropDuplicates(["path"])
    f = raw.select("path", decode(F.col("content")).alias("text"))
    return f.withColumn("format", detect_format(F.col("path"), F.col("text")))


def read_existing(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, DataFrame]:
    """(files, missing): files as of read_files; missing: each path that isn't there, with format `missing`."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    there = [p for p in paths if (h := jvm.org.apache.hadoop.fs.Path(p)).getFileSystem(conf).exists(h)]
    gone = spark.createDataFrame([(p, "missing") for p in dict.fromkeys(paths) if p not in there], "path string, format string")
    if not there:
        return spark.createDataFrame([], "path string, text string, format string"), gone
    return read_files(spark, there, glob="*"), gone


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def _split_lines(text: Column) -> Column:
    return F.split(text, "\r\n|\r|\n")


def detect_format(path: Column, text: Column) -> Column:
    """`trimble_dat`, `leica_gsi` or `unknown`: by the first ten lines, else by extension, else by file name."""
    head = F.slice(_split_lines(F.coalesce(text, F.lit(""))), 1, 10)
    trimble = F.exists(head, lambda s: s.contains("|") & (s.contains("For M5") | s.contains("KD1") | s.contains("TO")))
    leica = F.exists(F.transform(head, lambda s: F.btrim(s, F.lit(_BLANK))), lambda s: s.rlike("^(11|41)") | ((F.length(s) > 20) & F.regexp_extract(s, r"^(\S*)", 1).contains("+")))
    name = F.lower(file_name(path))
    return (
        F.when(trimble, "trimble_dat").when(leica, "leica_gsi").when(name.rlike(r".\.dat$"), "trimble_dat").when(name.rlike(r".\.(raw|gsi)$"), "leica_gsi")
        .when(name.contains("dat"), "trimble_dat").when(name.contains("raw"), "leica_gsi").otherwise("unknown")
    )


def endpoints_from_filename(name: Column) -> Column:
    """struct(start, end) of names such as A-B, A_B or 'A B' with or without `_raw`; null without such a pair."""
    clean = F.replace(F.replace(name, F.lit("_raw"), F.lit("")), F.lit(".raw"), F.lit(""))
    out = F.lit(None)
    for sep in (" ", "_", "-"):
        part = F.split(clean, sep)
        a, b = F.btrim(part[0]), F.btrim(F.try_element_at(part, F.lit(2)))
        out = F.when((a != "") & (b != ""), F.struct(a.alias("start"), b.alias("end"))).otherwise(out)
    return out


def _lines_of(files: DataFrame) -> DataFrame:
    cut = files.select("path", F.posexplode_outer(_split_lines(F.coalesce("text", F.lit("")))).alias("pos", "line"))
    return cut.withColumn("line", F.btrim("line", F.lit(_BLANK)))


def _number(line: Column, label: str) -> Column:
    # a plain search first: most lines lack most labels
    return F.when(line.contains(label), F.nullif(F.regexp_extract(line, label + r"\s+([0-9.-]+)\s*m", 1), F.lit("")))


def _finish(lines: DataFrame) -> DataFrame:
    bad = F.col("n_bad") > 0
    return lines.withColumn("status", F.when(bad, "parse_error").when(R.is_benchmark(F.col("end_point")), "valid").otherwise("invalid_endpoint")).drop("n_bad")


def parse_trimble(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Trimble DAT. setups: path, setup_number, from_point, to_point, backsight, foresight, dist_back, dist_fore,
    temperature, height_diff, cumulative_height. lines: path, filename, start_point, end_point, method, n_setups,
    total_distance, total_height_diff, status."""
    content = F.btrim(F.when(F.size(F.split("line", r"\|")) >= 3, F.split("line", r"\|")[2]), F.lit(_BLANK))
    t = _lines_of(files).withColumn("content", content)
    kd1, kd2 = F.col("content").startswith("KD1"), F.col("content").startswith("KD2")
    start = F.col("content").startswith("TO") & F.col("content").contains("Start-Line")
    point = F.when(kd1 | kd2, F.split(F.btrim(F.replace(F.substr("content", F.lit(4)), F.lit("#####"), F.lit("")), F.lit(_BLANK)), r"\s+")[0])
    on1 = lambda label: F.when(kd1, _number(F.col("line"), label))
    on2 = lambda label: F.when(kd2, _number(F.col("line"), label))
    raw = {"rb": on1("Rb"), "rf": on1("Rf"), "hd": on1("HD"), "z": on1("Z"), "sh": on1("Sh"), "db": on2("Db"), "df": on2("Df"), "temp": F.when(kd1, F.nullif(F.regexp_extract("line", r"([0-9.]+)\s*C", 1), F.lit("")))}
    kind = {"rb": _READING, "rf": _READING, "hd": _DIST, "z": _HEIGHT, "sh": _HEIGHT, "db": _DIST, "df": _DIST, "temp": "decimal(5,1)"}
    t = t.withColumns({f"s_{k}": c for k, c in raw.items()} | {"point": point})
    method = F.when(start & F.col("content").contains("BFFB"), "BFFB").when(start & F.col("content").contains("BF"), "BF").when(start & F.col("content").contains("FB"), "FB")
    bad = F.lit(0)
    for k in ("rb", "rf", "hd", "z", "db", "df", "temp"):
        bad = bad + F.when(F.col(f"s_{k}").isNotNull() & F.col(f"s_{k}").try_cast("double").isNull(), 1).otherwise(0)
    t = t.select("path", "pos", "point", *(F.col(f"s_{k}").try_cast(d).alias(k) for k, d in kind.items()), F.col("s_sh").isNotNull().alias("has_sh"), method.alias("method"), kd2.alias("kd2"), bad.alias("bad"))

    along = Window.partitionBy("path").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    last = lambda c: F.last(c, ignorenulls=True).over(along)
    is_rb = F.col("rb").isNotNull()
    t = t.withColumns({"back": last(F.when(is_rb, F.struct("rb", "point"))), "back_m": last(F.when(is_rb, F.col("hd"))), "now_temp": last(F.col("temp"))})
    t = t.withColumn("is_rf", F.col("rf").isNotNull() & F.col("back").isNotNull()).withColumn("setup_number", F.sum(F.col("is_rf").cast("int")).over(along).cast("int"))
    zero = F.lit(0).cast(_DIST)
    one = F.struct(
        F.col("back.point").alias("from_point"), F.col("point").alias("to_point"), F.col("back.rb").alias("backsight"), F.col("rf").alias("foresight"),
        F.coalesce("back_m", zero).alias("dist_back"), F.coalesce("hd", zero).alias("dist_fore"), F.col("now_temp").alias("temperature"),
    )
    setups = t.filter("setup_number > 0").groupBy("path", "setup_number").agg(F.max_by(one, F.when(F.col("is_rf"), F.col("pos"))).alias("s"), F.max_by("z", F.when(F.col("z").isNotNull(), F.col("pos"))).alias("cumulative_height"))
    setups = setups.select("path", "setup_number", "s.*", (F.col("s.backsight") - F.col("s.foresight")).cast(_READING).alias("height_diff"), "cumulative_height")

    when = lambda c: F.when(c, F.col("pos"))
    back = F.coalesce("back_m", zero)
    both = F.col("kd2") & F.col("db").isNotNull() & F.col("df").isNotNull()
    lines = t.groupBy("path").agg(
        F.min_by("point", when(is_rb & (F.col("point") != ""))).alias("start_point"),
        F.max_by("point", when(F.col("has_sh") | (F.col("kd2") & (F.col("point") != "")))).alias("end_point"),
        F.coalesce(F.max_by("method", when(F.col("method").isNotNull())), F.lit("BF")).alias("method"),
        F.max_by((F.col("db") + F.col("df")).cast("double") / 2, when(both)).alias("stored"), F.count_if("is_rf").alias("n_setups"),
        (F.sum(F.when(F.col("is_rf"), back + F.coalesce("hd", zero))).cast("double") / 2).alias("summed"),
        F.coalesce(F.sum(F.when(F.col("is_rf"), F.col("back.rb") - F.col("rf"))).cast("double"), F.lit(0.0)).alias("total_height_diff"), F.sum("bad").alias("n_bad"),
    )
    total = F.when(F.col("stored") != 0, F.col("stored")).otherwise(F.coalesce("summed", F.lit(0.0)))
    return setups, _finish(lines.select("path", stem(F.col("path")).alias("filename"), "start_point", "end_point", "method", "n_setups", total.alias("total_distance"), "total_height_diff", "n_bad"))


def gsi_words(line: Column, compat: bool = False) -> Column:
    """array of struct(index, sign, value) of a GSI line. compat drops all dots of the index part, so `32...8` is 328."""

    def word(w: Column) -> Column:
        left = F.regexp_extract(w, r"^([^+-]*)[+-]", 1)
        head = F.replace(left, F.lit("."), F.lit("")) if compat else F.split(left, r"\.")[0]
        n = F.length(head)
        idx = (
            F.when(n < 2, F.lit(None)).when((n > 3) & head.rlike("^(11|41)"), F.left(head, F.lit(2)))
            .when((n == 3) | head.rlike("^(331|332|335|336|57[1-4])"), F.left(head, F.lit(3))).otherwise(F.left(head, F.lit(2)))
        )
        return F.struct(idx.try_cast("int").alias("index"), F.regexp_extract(w, r"^[^+-]*([+-])", 1).alias("sign"), F.regexp_extract(w, r"^[^+-]*[+-](.*)$", 1).alias("value"))

    words = F.transform(F.split(line, r"\s+"), word)
    return F.filter(words, lambda w: w["index"].isNotNull() & ((w["index"] == 11) | w["value"].rlike("^[0-9]+$")))


def _word(line: Column, index: int, value: str = "[0-9]+") -> Column:
    """Sign and value of the last word of an index on a GSI line, by one expression; null without such a word.

    The index part ends at its first dot. Three digits stand for themselves; two are an index if not exactly one more follows.
    """
    head = f"{index}[^.+\\s-]*" if index > 99 else f"{index}(?:[^.+\\s-]{{2,}})?"
    own = rf"^(?:.*\s)?{head}(?:\.[^+\s-]*)?([+-]{value})(?:\s.*)?$"
    return F.when(line.contains(str(index)), F.nullif(F.regexp_extract(line, own, 1), F.lit("")))


def parse_leica(files: DataFrame, compat: bool = False, wi573: str = "delta") -> tuple[DataFrame, DataFrame]:
    """Leica GSI; columns as of parse_trimble. wi573: `delta` overrides height_diff, `cumulative` sets cumulative_height."""
    if wi573 not in ("delta", "cumulative"):
        raise ValueError(f"unknown meaning of word 573: {wi573!r}")
    t = _lines_of(files).filter((F.col("pos") == 0) | F.col("line").rlike("[+-]"))
    if compat:
        t = t.withColumn("words", gsi_words(F.col("line"), compat))
        last = lambda i: F.try_element_at(F.filter("words", lambda w: w["index"] == i), F.lit(-1))
        text = lambda i: F.concat(last(i)["sign"], last(i)["value"])
    else:
        text = lambda i: _word(F.col("line"), i, r"\S*" if i == 11 else "[0-9]+")
    numbers = (32, 331, 332, 335, 336, 573, 574)
    t = t.select("path", "pos", text(11).alias("t11"), *(text(i).alias(f"t{i}") for i in numbers), text(83).isNotNull().alias("has83"))
    metres = lambda i: (F.col(f"t{i}").try_cast("decimal(18,0)") * F.lit("0.00001").cast("decimal(6,5)")).cast(_HEIGHT)
    p = F.regexp_replace(F.substr("t11", F.lit(2)), "^0+", "")
    t = t.select("path", "pos", F.when(F.col("t11").isNotNull(), F.when(p == "", "0").otherwise(p)).alias("point"), *(metres(i).alias(f"w{i}") for i in numbers), "has83")
    face = lambda a, b: F.coalesce(F.nullif(F.col(a), F.lit(0)), F.col(b)) if compat else F.coalesce(a, b)
    has = lambda a, b: F.col(a).isNotNull() | F.col(b).isNotNull()
    named = F.col("point").isNotNull()
    along = Window.partitionBy("path").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    zero = F.lit(0).cast(_DIST)
    sight = F.coalesce(F.col("w32").cast(_DIST), zero)
    t = t.withColumn("back", F.last(F.when(has("w331", "w335") & named, F.struct("point", face("w331", "w335").cast(_READING).alias("bs"), sight.alias("m"))), ignorenulls=True).over(along))
    t = t.withColumn("is_fs", has("w332", "w336") & named & F.col("back.bs").isNotNull()).withColumn("fs", face("w332", "w336").cast(_READING))
    t = t.withColumn("setup_number", F.sum(F.col("is_fs").cast("int")).over(along).cast("int"))
    one = F.struct(
        F.col("back.point").alias("from_point"), F.col("point").alias("to_point"), F.col("back.bs").alias("backsight"), F.col("fs").alias("foresight"), F.col("back.m").alias("dist_back"), sight.alias("dist_fore"),
        F.lit(None).cast("decimal(5,1)").alias("temperature"),
    )
    when = lambda c: F.when(c, F.col("pos"))
    s = t.filter("setup_number > 0").groupBy("path", "setup_number").agg(F.max_by(one, when(F.col("is_fs"))).alias("s"), F.max_by("w573", when(F.col("w573").isNotNull())).alias("d"))
    dh = (F.col("s.backsight") - F.col("s.foresight")).cast(_READING)
    delta = wi573 == "delta"
    setups = s.select("path", "setup_number", "s.*", (F.coalesce(F.col("d").cast(_READING), dh) if delta else dh).alias("height_diff"), (F.lit(None).cast(_HEIGHT) if delta else F.col("d")).alias("cumulative_height"))

    mark = named & R.is_benchmark(F.col("point"))
    per = t.groupBy("path").agg(
        F.min_by("point", when(F.col("has83") & mark)).alias("first83"), F.transform(F.array_sort(F.collect_list(F.when(mark, F.struct("pos", "point")))), lambda x: x["point"]).alias("marks"),
        F.max_by("point", when(named & (F.col("point") != "0"))).alias("last_point"), F.max("w574").cast("double").alias("w574"),
    )
    sums = setups.groupBy("path").agg(F.count(F.lit(1)).alias("n_setups"), (F.sum(F.col("dist_back") + F.col("dist_fore")).cast("double") / 2).alias("summed"), F.sum("height_diff").cast("double").alias("dh"))
    ln = per.join(sums, "path", "left").withColumn("filename", stem(F.col("path"))).withColumn("named", endpoints_from_filename(F.col("filename")))
    seen = lambda c: F.coalesce(F.array_contains("marks", c), F.lit(False))
    ln = ln.withColumn("start_point", F.when(seen(F.col("named.start")) & F.col("named").isNotNull(), F.col("named.start")).otherwise(F.coalesce("first83", F.try_element_at("marks", F.lit(1)))))
    ln = ln.withColumn("other", F.try_element_at(F.filter("marks", lambda x: ~x.eqNullSafe(F.col("start_point"))), F.lit(-1)))
    end = F.when(seen(F.col("named.end")) & F.col("named").isNotNull(), F.col("named.end")).otherwise(F.col("other"))
    ln = ln.withColumn("end_point", end).withColumn("end_point", F.when(F.col("end_point").isNull() | F.col("end_point").eqNullSafe(F.col("start_point")), F.coalesce("named.end", "last_point", "end_point")).otherwise(F.col("end_point")))
    total = F.when(F.col("w574") > 0, F.col("w574")).otherwise(F.coalesce("summed", F.lit(0.0)))
    out = ln.select("path", "filename", "start_point", "end_point", F.lit("BF").alias("method"), F.coalesce("n_setups", F.lit(0)).alias("n_setups"), total.alias("total_distance"), F.coalesce("dh", F.lit(0.0)).alias("total_height_diff"), F.lit(0).alias("n_bad"))
    return setups, _finish(out)


PARSERS = {"trimble_dat": parse_trimble, "leica_gsi": parse_leica}


def parse_files(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(setups, lines, rejected) of files with a format column; rejected: the path of each file of unknown format."""
    both = [f(files.filter(F.col("format") == name)) for name, f in PARSERS.items()]
    (s, ln), *rest = both
    for s2, l2 in rest:
        s, ln = s.unionByName(s2), ln.unionByName(l2)
    return s, ln, files.filter(~F.col("format").isin(*PARSERS)).select("path", "format")


def render_trimble(stations: DataFrame) -> DataFrame:
    """(path, text) of stations with path, method, points, readings and distances: what parse_trimble reads back."""
    num = lambda c, d: c.cast(f"decimal(12,{d})").cast("string")
    sight = lambda p, label, r, m: F.concat(F.lit("For M5|Adr|KD1 "), p, F.lit("      22.0 C|"), F.lit(label + " "), num(r, 5), F.lit(" m   |HD "), num(m, 3), F.lit(" m   |"))
    two = F.concat(sight(F.col("from_point"), "Rb", F.col("backsight"), F.col("dist_back")), F.lit("\n"), sight(F.col("to_point"), "Rf", F.col("foresight"), F.col("dist_fore")))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("setup_number", two.alias("t")))), lambda x: x["t"]), "\n")
    end = F.concat(F.lit("For M5|Adr|KD2 "), F.max_by("to_point", "setup_number"), F.lit("    |"))
    return stations.groupBy("path").agg(F.concat(F.lit("For M5|Adr|TO  Start-Line "), F.first("method"), F.lit("|\n"), body, F.lit("\n"), end).alias("text"))


def render_gsi(stations: DataFrame) -> DataFrame:
    """(path, text) in GSI words: readings and distances in 0.01 mm."""
    raw = lambda c: F.lpad((c * 100000).cast("decimal(18,0)").cast("string"), 16, "0")
    sight = lambda p, wi, r, m: F.concat(F.lit("110001+"), F.lpad(p, 16, "0"), F.lit(" 32...8+"), raw(m), F.lit(f" {wi}.08+"), raw(r))
    two = F.concat(sight(F.col("from_point"), 331, F.col("backsight"), F.col("dist_back")), F.lit("\n"), sight(F.col("to_point"), 332, F.col("foresight"), F.col("dist_fore")))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("setup_number", two.alias("t")))), lambda x: x["t"]), "\n")
    return stations.groupBy("path").agg(body.alias("text"))


def load_coordinates(spark: SparkSession, path: str) -> DataFrame:
    """point_id, lon, lat, height of `id,lon,lat[,height]` lines; `#` lines and lines of fewer parts are skipped."""
    p = F.split("value", ",")
    num = lambda i: F.btrim(F.try_element_at(p, F.lit(i))).try_cast("double")
    rows = spark.read.text(path).filter(~F.btrim("value").startswith("#") & (F.size(p) >= 3))
    return rows.select(F.btrim(p[0]).alias("point_id"), num(2).alias("lon"), num(3).alias("lat"), F.coalesce(num(4), F.lit(0.0)).alias("height"))


def parse_trimble_dat(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(setups, lines) of Trimble files below a path, whatever they are called."""
    return parse_trimble(read_files(spark, path, glob="*"))


def parse_leica_gsi(spark: SparkSession, path: str, compat: bool = False) -> tuple[DataFrame, DataFrame]:
    return parse_leica(read_files(spark, path, glob="*"), compat)


def trimble_detect(path: Column, text: Column) -> Column:
    return detect_format(path, text) == "trimble_dat"


def leica_detect(path: Column, text: Column) -> Column:
    return detect_format(path, text) == "leica_gsi"
