"""Raw recordings: text and CSV files of accelerometer and barometer readings and named markers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspark.functions.scalars import number, per_second, unit_from_size, unit_from_step
from loomspark.operators.tables import quantiles
from loomspark.operators.windows import valid_markers

#: Header names of CSV recordings, first match first.
TIME, NAME, PRESSURE = ("t", "timestamp", "time"), ("name", "marker", "event", "label"), ("p", "pressure", "baro", "barometer")
#: Dense streams need so many readings and positive steps before their rate tells the unit.
READINGS, STEPS = 10, 5


def discover(spark: SparkSession, root: str | Sequence[str], exclude: str = r"(features_|params|scaler|resampled)") -> DataFrame:
    """``rec`` (path), ``line`` and ``text`` of all lines of ``*.txt`` and ``*.csv`` files below the roots, artefacts left out.

    Files are read by lines and large ones in blocks, by several tasks.  A block's lines are numbered from its offset, so
    numbers grow along a file, without each being one more than the last.
    """
    read = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.{txt,csv}").text([root] if isinstance(root, str) else list(root))
    rows = read.select(F.col("_metadata.file_path").alias("rec"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__id"), F.col("value").alias("text"))
    rows = rows.where(~F.regexp_extract("rec", r"([^/]*)$", 1).rlike(exclude))
    first = F.min("__id").over(Window.partitionBy("rec", "__block"))
    return rows.select("rec", (F.col("__block") + F.col("__id") - first).alias("line"), "text")


def domain(path: str = "rec"):
    low = F.lower(F.col(path))
    return F.when(low.contains("/nonflight/"), "nonflight").when(low.contains("/flight/"), "flight")


def parse_text(lines: DataFrame) -> DataFrame:
    """``rec, line, kind, name, ts, x, y, z`` of the lines that can be read: markers ``name;ts``, pressures ``ts:p``, accelerations ``ts:x:y:z``.

    Blank lines and lines that begin with "mer data" are skipped; a marker line that can't be read is tried as readings.
    """
    t = F.trim(F.regexp_replace("text", r"^\s+|\s+$", ""))
    rows = lines.withColumn("text", t).where((F.col("text") != "") & ~F.lower("text").startswith("mer data"))
    rows = rows.withColumns({"m": F.split("text", ";"), "r": F.split("text", ":")})
    at = lambda c, i: number(F.get(F.col(c), F.lit(i)))
    marker = (F.size("m") == 2) & at("m", 1).isNotNull()
    size = F.size("r")
    kind = F.when(marker, "marker").when((size == 2) & at("r", 0).isNotNull() & at("r", 1).isNotNull(), "baro")
    kind = kind.when((size == 4) & at("r", 0).isNotNull() & at("r", 1).isNotNull() & at("r", 2).isNotNull() & at("r", 3).isNotNull(), "accel")
    rows = rows.withColumn("kind", kind).where("kind is not null")
    ts = F.when(F.col("kind") == "marker", at("m", 1)).otherwise(at("r", 0))
    reading = F.col("kind") != "marker"
    return rows.select("rec", "line", "kind", F.when(~reading, F.trim(F.get("m", F.lit(0)))).alias("name"), ts.alias("ts"), *(F.when(reading, at("r", i)).alias(c) for i, c in ((1, "x"), (2, "y"), (3, "z"))))


def parse_csv(rows: DataFrame) -> DataFrame | None:
    """The same from a headed CSV frame with a ``rec`` column (all text), or None if it holds no time or no stream."""
    by = {c.lower(): c for c in rows.columns}
    pick = lambda names: next((F.col(f"`{by[n]}`") for n in names if n in by), None)
    t, name, p = pick(TIME), pick(NAME), pick(PRESSURE)
    axes = [pick((a,)) for a in ("ax", "ay", "az")]
    if t is None or name is None and p is None and None in axes:
        return None
    rows = rows.withColumn("__ts", number(t.cast("string"))).where("__ts is not null").withColumn("__line", F.monotonically_increasing_id())
    none, text = F.lit(None).cast("double"), F.lit(None).cast("string")
    out = []
    if name is not None:
        out.append(rows.where(F.trim(name) != "").select("rec", "__line", F.lit("marker"), F.trim(name), "__ts", none, none, none))
    if p is not None:
        out.append(rows.where(number(p.cast("string")).isNotNull()).select("rec", "__line", F.lit("baro"), text, "__ts", number(p.cast("string")), none, none))
    if None not in axes:
        v = [number(a.cast("string")) for a in axes]
        out.append(rows.where(v[0].isNotNull() | v[1].isNotNull() | v[2].isNotNull()).select("rec", "__line", F.lit("accel"), text, "__ts", *v))
    found = out[0]
    for o in out[1:]:
        found = found.union(o)
    return found.toDF("rec", "line", "kind", "name", "ts", "x", "y", "z")


def parse_csv_lines(lines: DataFrame) -> DataFrame:
    """The same from the lines of headed CSV files, each by its own header; files that hold no time or no stream have no row.

    Names are those of :func:`parse_csv`, in any case, the first of a kind that a header has.  Fields may be quoted.
    """
    cells = F.transform(F.split("text", ',(?=(?:[^"]*"[^"]*")*[^"]*$)'), lambda x: F.regexp_replace(F.trim(x), '^"|"$', ""))
    rows = lines.withColumn("cells", cells)
    head = rows.groupBy("rec").agg(F.min_by(F.transform("cells", lambda x: F.lower(x)), "line").alias("head"), F.min("line").alias("__first"))
    place = lambda names: F.coalesce(*(F.nullif(F.array_position("head", n), F.lit(0)) for n in names))
    spots = {"__t": TIME, "__name": NAME, "__p": PRESSURE, "__ax": ("ax",), "__ay": ("ay",), "__az": ("az",)}
    head = head.select("rec", "__first", *(place(names).cast("int").alias(c) for c, names in spots.items()))
    axes = F.col("__ax").isNotNull() & F.col("__ay").isNotNull() & F.col("__az").isNotNull()
    head = head.where(F.col("__t").isNotNull() & (F.col("__name").isNotNull() | F.col("__p").isNotNull() | axes)).withColumn("__axes", axes)
    rows = rows.join(head, "rec").where("line > __first")
    text = lambda c: F.get("cells", F.col(c) - 1)
    rows = rows.withColumn("ts", number(text("__t"))).where("ts is not null")
    none, empty = F.lit(None).cast("double"), F.lit(None).cast("string")
    x, y, z = (number(text(c)) for c in ("__ax", "__ay", "__az"))

    def made(kind: str, when: Column, name: Column, *values: Column) -> Column:
        return F.when(when, F.struct(F.lit(kind).alias("kind"), name.alias("name"), *(v.alias(n) for n, v in zip("xyz", values))))

    found = F.array(
        made("marker", F.col("__name").isNotNull() & (F.trim(text("__name")) != ""), F.trim(text("__name")), none, none, none),
        made("baro", number(text("__p")).isNotNull(), empty, number(text("__p")), none, none),
        made("accel", F.col("__axes") & (x.isNotNull() | y.isNotNull() | z.isNotNull()), empty, x, y, z),
    )
    return rows.select("rec", "line", "ts", F.explode(F.filter(found, lambda r: r.isNotNull())).alias("r")).select("rec", "line", "r.kind", "r.name", "ts", "r.x", "r.y", "r.z")


def parse_files(lines: DataFrame) -> DataFrame:
    """All files of a folder: CSV files by their headers, and the others, and CSV files that can't be read so, as text."""
    is_csv = F.lower("rec").endswith(".csv")
    by_header = parse_csv_lines(lines.where(is_csv))
    rest = lines.join(by_header.select("rec").distinct(), "rec", "left_anti")
    return by_header.unionByName(parse_text(rest))


def units(parsed: DataFrame) -> DataFrame:
    """``rec, unit`` of the times: by the rate of the accelerations, else of the pressures, else by size, else ms."""
    w = Window.partitionBy("rec", "kind").orderBy("line")
    steps = parsed.where("kind <> 'marker'").withColumn("d", F.col("ts") - F.lag("ts").over(w))
    sizes = steps.groupBy("rec", "kind").agg(F.count("*").alias("__all"))
    found = quantiles(steps.where("d > 0"), "d", [0.5], "rec", "kind")
    dense = sizes.join(found, ["rec", "kind"]).where((F.col("__all") >= READINGS) & (F.col("n") >= STEPS)).select("rec", "kind", F.col("q")[0].alias("step"))
    by = lambda kind: F.max(F.when(F.col("kind") == kind, unit_from_step(F.col("step"))))
    rates = dense.groupBy("rec").agg(by("accel").alias("a"), by("baro").alias("b"))
    sizes = parsed.groupBy("rec").agg(unit_from_size(F.max(F.abs("ts"))).alias("m"))
    return sizes.join(rates, "rec", "left").select("rec", F.coalesce("a", "b", "m", F.lit("ms")).alias("unit"))


def recordings(parsed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Accelerations ``(rec, t, ax, ay, az)``, pressures ``(rec, t, p)`` and valid markers ``(rec, name, t)``, in seconds."""
    timed = parsed.join(units(parsed), "rec").withColumn("t", F.col("ts") / per_second(F.col("unit")))
    accel = timed.where("kind = 'accel'").select("rec", "t", F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("z").alias("az"))
    baro = timed.where("kind = 'baro'").select("rec", "t", F.col("x").alias("p"))
    spans = timed.where("kind <> 'marker'").groupBy("rec").agg(F.min("t").alias("start"), F.max("t").alias("stop"))
    return accel, baro, valid_markers(timed.where("kind = 'marker'").select("rec", "name", "t", "line"), spans)
