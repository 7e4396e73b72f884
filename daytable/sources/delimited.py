"""Delimited text: incidents, readings and price bars, one row per line, fields by position."""

import re
from collections import Counter
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from daytable.functions.scalars import num0, parse_day


#: Files whose names are broadcast to meet their series; more are joined by shuffle.
MOST_FILES = 50_000


@dataclass(frozen=True)
class Layout:
    """Where the fields are: position, and string, int, bigint, float or double; the day's position and pattern."""

    sep: str
    width: int
    day: int
    pattern: str | None
    fields: dict[str, tuple[int, str]] = field(default_factory=dict)
    header: bool = True

    @property
    def last(self) -> int:
        return max(self.day, *(i for i, _ in self.fields.values()))


INCIDENTS = Layout(";", 22, 2, "MM/dd/yyyy hh:mm:ss a", {"iucr": (4, "string"), "primarytype": (5, "string"), "description": (6, "string"), "locationdescription": (7, "string"), "fbicode": (14, "string")})
READINGS = Layout(
    ",", 25, 1, None,
    {"temp": (6, "float"), "feels_like": (7, "float"), "temp_min": (8, "float"), "temp_max": (9, "float"), "pressure": (10, "int"), "humidity": (13, "int"), "wind_speed": (14, "float"), "wind_deg": (15, "int"), "rain_1h": (16, "float"), "rain_3h": (17, "float"), "snow_1h": (18, "float"), "snow_3h": (19, "float"), "clouds_all": (20, "int"), "weather_id": (21, "int"), "weather_main": (22, "string"), "weather_description": (23, "string")},
)
BARS = Layout(",", 7, 0, "yyyy-MM-dd", {"open": (1, "double"), "high": (2, "double"), "low": (3, "double"), "close": (4, "double"), "adjclose": (5, "double"), "volume": (6, "double")})


def typed(parts: list[Column], layout: Layout) -> list[Column]:
    """The day and the fields, from the text of each position."""
    out = [parse_day(parts[layout.day], layout.pattern).alias("day")]
    for name, (i, kind) in layout.fields.items():
        out.append((F.coalesce(parts[i], F.lit("")) if kind == "string" else num0(parts[i], kind)).alias(name))
    return out


def raw_lines(spark: SparkSession, path: str | list[str], layout: Layout, quote: str = "") -> DataFrame:
    """All positions as text, of files with a header and # comments."""
    return spark.read.csv(path, sep=layout.sep, header=layout.header, quote=quote, comment="#", enforceSchema=True, schema=", ".join(f"_{i} string" for i in range(layout.width)))


def is_full(layout: Layout) -> Column:
    """Whether a line reaches the last position that is needed; trailing empty fields don't count."""
    return F.coalesce(*(F.col(f"_{i}") for i in range(layout.last, layout.width))).isNotNull()


def typed_all(layout: Layout) -> list[Column]:
    return typed([F.col(f"_{i}") for i in range(layout.width)], layout)


def read_delimited(spark: SparkSession, path: str | list[str], layout: Layout, quote: str = "") -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of files with a header and # comments. A line is rejected when all positions from the last one that
    is needed on are empty: it is too short, trailing empty fields not counted. Rejects hold all positions as text."""
    raw = raw_lines(spark, path, layout, quote)
    return raw.filter(is_full(layout)).select(*typed_all(layout)), raw.filter(~is_full(layout))


def read_counted(spark: SparkSession, path: str | list[str], layout: Layout, quote: str = "", name: str | None = None) -> tuple[DataFrame, Observation]:
    """(rows, counts) in one scan: once an action has run over the rows, counts.get has `lines` (header and comments left out), `rejects`
    and `undated`, the kept lines whose day doesn't parse. For no lines all three are 0."""
    counts = Observation(name) if name else Observation()
    day = parse_day(F.col(f"_{layout.day}"), layout.pattern)
    full = raw_lines(spark, path, layout, quote).withColumn("__full", is_full(layout))
    seen = full.observe(counts, F.count(F.lit(1)).alias("lines"), F.count_if(~F.col("__full")).alias("rejects"), F.count_if(F.col("__full") & day.isNull()).alias("undated"))
    return seen.filter("__full").select(*typed_all(layout)), counts


def split_rows(lines: DataFrame, layout: Layout, line: str = "line") -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of a column of lines, by the same rules. Other columns stay."""
    whole = F.coalesce(F.col(line), F.lit(""))
    kept = lines.filter(~whole.startswith("#"))
    parts = F.split(F.rtrim(whole, F.lit(layout.sep)), "\\" + layout.sep)
    full = lambda p: F.size(p) > layout.last
    rest = [c for c in lines.columns if c != line]
    at = [F.get(F.col("__parts"), F.lit(i)) for i in range(layout.width)]
    split = kept.select(*rest, F.explode(F.filter(F.array(parts), full)).alias("__parts"))  # each line is split once
    return split.select(*rest, *typed(at, layout)), kept.filter(~full(parts))


def read_incidents(spark: SparkSession, path: str | list[str], layout: Layout = INCIDENTS) -> DataFrame:
    return read_delimited(spark, path, layout)[0]


def read_readings(spark: SparkSession, path: str | list[str], layout: Layout = READINGS) -> DataFrame:
    return read_delimited(spark, path, layout)[0]


def file_key(path: Column | str) -> Column:
    """A file's path without its scheme and host, by which a path that was asked for and one that was read meet."""
    return F.regexp_replace(F.lit(path) if isinstance(path, str) else path, "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")


def read_bars(spark: SparkSession, paths: dict[str, str | list[str]], layout: Layout = BARS) -> DataFrame:
    """The bars of all series, each file with its series' id, in one scan of all files.

    A path is a file, a folder of files or a pattern; each is listed once, and files meet their series by their full path. A path
    without files is an error, and so is a file that two series name."""
    files = [(f, i) for i, path in paths.items() for p in ([path] if isinstance(path, str) else path) for f in listed(spark, p)]
    twice = [f for f, n in Counter(f for f, _ in set(files)).items() if n > 1]
    if twice:
        raise ValueError(f"files of more than one series: {', '.join(sorted(twice)[:5])}")
    series = spark.createDataFrame([(i, f) for f, i in sorted(set(files))], "id string, __file string").select("id", file_key(F.col("__file")).alias("__file"))
    plain = [re.sub(r"([\[\]{}*?\\])", r"\\\1", f) for f in sorted({f for f, _ in files})]  # names are no patterns
    raw = raw_lines(spark, plain, layout).withColumn("__path", file_key(F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B")))))
    rows = raw.filter(is_full(layout)).select(*typed_all(layout), "__path")
    known = rows.join(F.broadcast(series) if len(files) <= MOST_FILES else series, F.col("__path") == F.col("__file"), "left")
    unknown = F.raise_error(F.concat(F.lit("a file of no series: "), F.col("__path"))).cast("string")
    return known.withColumn("id", F.coalesce("id", unknown)).drop("__path", "__file")


def listed(spark: SparkSession, path: str) -> list[str]:
    """The files that a path, a folder or a pattern stands for, hidden ones and those of folders below left out."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [s for top in system.globStatus(at) or [] for s in (system.listStatus(top.getPath()) if top.isDirectory() else [top])]
    files = [s.getPath() for s in found if s.isFile() and s.getPath().getName()[0] not in "_."]
    if not files:
        raise ValueError(f"no files in {path}")
    return [f.toString() for f in files]
