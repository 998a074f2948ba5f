"""Readers and writers: schemas are given, never inferred, and what doesn't fit fails."""

from __future__ import annotations

import json
from pathlib import PurePath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from evalloom.operators.relations import CheckFailed


def read_jsonl(spark: SparkSession, path: str, schema: str | StructType, allow_missing: bool = False, nonempty: bool = False) -> DataFrame:
    """One object per line; blank lines are skipped, a broken one fails."""
    if allow_missing and not exists(spark, path):
        return spark.createDataFrame([], schema)
    df = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    if nonempty and df.isEmpty():
        raise CheckFailed(f"{path} holds no rows")
    return df


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_csv(spark: SparkSession, path: str, schema: str | StructType, blanks_are_null: bool = True) -> DataFrame:
    """With a header; fields may hold line breaks and doubled quotes."""
    df = spark.read.schema(schema).csv(path, header=True, multiLine=True, quote='"', escape='"', mode="FAILFAST", nullValue="" if blanks_are_null else "\0")
    return df


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """The distinct lines that aren't blank, trimmed."""
    return spark.read.text(path).select(F.trim("value").alias("value")).filter("value <> ''").distinct()


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, idx, value): lines with their place in the file. Files are read whole, so they must be small."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.posexplode(F.split("value", "\r?\n")).alias("idx", "value"))
    return whole.filter(F.trim("value") != "")


def actions_of(trace: Column) -> Column:
    """The actions, each as JSON text, of a trace as a JSON list, an object with actions, or a line per action."""
    t = F.trim(trace)
    wrapped = F.from_json(F.get_json_object(t, "$.actions"), "array<string>")
    lines = F.filter(F.split(t, "\r?\n"), lambda x: F.trim(x) != "")
    return F.when(t.startswith("["), F.from_json(t, "array<string>")).otherwise(F.coalesce(wrapped, lines))


def read_actions(spark: SparkSession, path: str) -> DataFrame:
    """(seq, action) of the trace in a file, as from actions_of."""
    return spark.read.text(path, wholetext=True).select(F.posexplode(actions_of(F.col("value"))).alias("seq", "action"))


def query(spark: SparkSession, sql: str, tables: dict[str, DataFrame], **args) -> DataFrame:
    """A parameterised query over DataFrames by name."""
    return spark.sql(sql, args=args or None, **tables) if not args else _named(spark, sql, tables, args)


def _named(spark: SparkSession, sql: str, tables: dict[str, DataFrame], args: dict) -> DataFrame:
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    return spark.sql(sql, args=args)


def source_states(lock: DataFrame, found: DataFrame, refresh: bool = False, offline: bool = False) -> DataFrame:
    """(name, state): what a locked file needs. found: name, sha256, bytes of what lies in the cache.

    verified files stay unless refresh; others are to be fetched, which offline forbids.
    """
    there = found.select("name", F.col("sha256").alias("_s"), F.col("bytes").alias("_b"))
    good = F.coalesce((F.col("sha256") == F.col("_s")) & (F.col("bytes") == F.col("_b")), F.lit(False))
    need = F.when(F.lit(offline), F.when(F.col("_s").isNull(), "missing_offline").otherwise("mismatch_offline")).otherwise(F.when(F.col("_s").isNull(), "fetch").otherwise("replace"))
    return lock.join(there, "name", "left").select("name", F.when(good & F.lit(not refresh or offline), "verified").when(good, "replace").otherwise(need).alias("state"))


def closed_contract(fields: dict[str, object], names: set[str]) -> dict[str, object]:
    """A manifest part that must have exactly these fields, none of them null."""
    if wrong := sorted(set(fields) ^ names):
        raise CheckFailed(f"fields that are missing or unknown: {', '.join(wrong)}")
    if empty := sorted(k for k, v in fields.items() if v is None):
        raise CheckFailed(f"fields without a value: {', '.join(empty)}")
    return dict(sorted(fields.items()))


def verified_files(spark: SparkSession, paths: list[str], lock: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files against a lock table (name, sha256, bytes): the report, and the names that don't agree.

    Digests are taken where the files are read; their contents go nowhere.
    """
    found = spark.read.format("binaryFile").load(paths).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("found_sha256"), F.col("length").alias("found_bytes"))
    report = lock.join(found, "name", "full_outer").withColumn("verified", F.coalesce((F.col("sha256") == F.col("found_sha256")) & (F.col("bytes") == F.col("found_bytes")), F.lit(False)))
    return report, report.filter("NOT verified").select("name")


def sorted_json(df: DataFrame, column: str = "value", pretty: bool = False) -> DataFrame:
    """Rows as JSON text with keys in order at every level; nulls are told and NaN is null. pretty: indented, over several lines."""

    def tidy(c, kind):
        if isinstance(kind, StructType):
            return F.when(c.isNotNull(), F.struct(*[tidy(c[f.name], f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name)]))
        if isinstance(kind, ArrayType):
            return F.transform(c, lambda x: tidy(x, kind.elementType))
        if isinstance(kind, MapType):
            return F.map_from_entries(F.array_sort(F.map_entries(c)))
        if kind.typeName() in ("double", "float"):
            return F.when(~F.isnan(c), c)
        return c

    cols = [tidy(F.col(f.name), f.dataType).alias(f.name) for f in sorted(df.schema.fields, key=lambda f: f.name)]
    return df.select(F.to_json(F.struct(*cols), {"ignoreNullFields": "false", "pretty": str(pretty).lower()}).alias(column))


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One compact object per line, as a reader of lines needs it."""
    sorted_json(df).write.mode(mode).text(path)


def append_jsonl(df: DataFrame, path: str) -> None:
    write_jsonl(df, path, mode="append")


def multiset_digest(df: DataFrame) -> tuple[int, str, str]:
    """Of lines (value): (rows, two sums of 60 digest bits each), equal for equal rows in any order, copies counted. One pass, one row out.

    It tells apart what differs by accident, not by design.
    """
    rows = df.select(F.sha2("value", 256).alias("mark"))
    bits = lambda at: F.coalesce(F.sum(F.conv(F.substring("mark", at, 15), 16, 10).cast("decimal(20,0)")), F.lit(0)).cast("string")
    r = rows.agg(F.count("*").alias("n"), bits(1).alias("a"), bits(16).alias("b")).head()
    return r.n, r.a, r.b


DIGEST = "rows long, a string, b string"


def committed(spark: SparkSession, path: str) -> tuple[int, str, str] | None:
    """The digest of the rows at path, which is written after them; None where there is none."""
    return tuple(spark.read.schema(DIGEST).json(f"{path}.digest").head()) if exists(spark, f"{path}.digest") else None


def read_committed(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """Rows that write_once wrote to their end; others are refused."""
    if committed(spark, path) is None:
        raise CheckFailed(f"{path} was not written to its end")
    return read_jsonl(spark, path, schema)


def write_once(df: DataFrame, path: str) -> bool:
    """Write JSON lines; a path that is written must hold the same rows already. True if they were written.

    What is written is read back and digested, and the digest is stored beside it, last: a write that was broken
    off has none, and is done again if it left no rows. Rows without a digest are never overwritten: they get one
    if they are the same, else they are refused. Later calls digest their rows in one pass and don't read the stored ones.
    """
    spark, rows = df.sparkSession, sorted_json(df)
    held = committed(spark, path)
    if held is None:
        there = exists(spark, path) and not spark.read.text(path).isEmpty()
        if not there:
            rows.write.mode("overwrite").text(path)
        held = multiset_digest(spark.read.text(path))
        if held != multiset_digest(rows):
            raise CheckFailed(f"{path} holds other rows")
        spark.createDataFrame([held], DIGEST).coalesce(1).write.mode("errorifexists").json(f"{path}.digest")
        return not there
    if held != multiset_digest(rows):
        raise CheckFailed(f"{path} holds other rows")
    return False


def write_small_csv(df: DataFrame, path: str) -> None:
    """One file with a header, for tables that fit in one task."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True, quoteAll=False, escape='"')


def write_table(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Parquet, in folders by the columns that queries filter on."""
    w = df.write.mode("overwrite")
    (w.partitionBy(*by) if by else w).parquet(path)


def markdown(df: DataFrame, most: int = 1_000) -> str:
    """A small table as Markdown; a large one is refused."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise CheckFailed(f"more than {most} rows")
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    head = ["| " + " | ".join(df.columns) + " |", "| " + " | ".join("---" for _ in df.columns) + " |"]
    return "\n".join(head + ["| " + " | ".join(cell(v) for v in r) + " |" for r in rows]) + "\n"


def manifest(parts: dict[str, object], tables: dict[str, DataFrame], most: int = 1_000) -> str:
    """A JSON report: plain parts, and small tables as lists of records."""
    out = dict(parts)
    for name, df in tables.items():
        rows = sorted_json(df).limit(most + 1).collect()
        if len(rows) > most:
            raise CheckFailed(f"{name} has more than {most} rows")
        out[name] = [json.loads(r.value) for r in rows]
    return json.dumps(out, indent=2, sort_keys=True, ensure_ascii=False, default=lambda v: str(v) if isinstance(v, PurePath) else v) + "\n"


def scatter_svg(rows: list[dict], x: str, y: str, label: str, title: str, width: int = 720, height: int = 480) -> str:
    """A frontier chart of a few collected rows: points with labels, the frontier's ones filled."""
    pad = 60
    xs, ys = [float(r[x]) for r in rows] or [0.0], [float(r[y]) for r in rows] or [0.0]
    span = lambda v: (min(v), (max(v) - min(v)) or 1.0)
    (x0, dx), (y0, dy) = span(xs), span(ys)
    esc = lambda s: str(s).replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    out = [f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}" role="img"><title>{esc(title)}</title>', f'<path d="M{pad} {pad}V{height - pad}H{width - pad}" fill="none" stroke="#444"/>']
    for r in sorted(rows, key=lambda r: (float(r[x]), str(r[label]))):
        px, py = pad + (float(r[x]) - x0) / dx * (width - 2 * pad), height - pad - (float(r[y]) - y0) / dy * (height - 2 * pad)
        out.append(f'<circle cx="{px:.1f}" cy="{py:.1f}" r="5" fill="{"#1f5fa8" if r.get("on_frontier") else "none"}" stroke="#1f5fa8"/><text x="{px + 8:.1f}" y="{py - 8:.1f}" font-size="12">{esc(r[label])}</text>')
    return "\n".join([*out, "</svg>"]) + "\n"
