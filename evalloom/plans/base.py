"""The tables the queries run over, as one SQL text each that Spark and the comparison engine both read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: {name} stands for a stored table.
BASE = {
    "samples": "SELECT l_orderkey AS case_id, l_linenumber AS sample_idx, CASE WHEN l_linenumber % 2 = 1 THEN 'qa' ELSE 'conv' END AS task_type, CASE WHEN l_linenumber = 7 THEN 'E' WHEN l_quantity <= 13 THEN 'A' WHEN l_quantity <= 25 THEN 'B' WHEN l_quantity <= 38 THEN 'C' ELSE 'D' END AS label FROM {lineitem}",
    "gold": "SELECT o_orderkey AS case_id, c_mktsegment AS dataset, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'D' WHEN '2' THEN 'C' WHEN '3' THEN 'B|C' WHEN '4' THEN 'B' ELSE 'A' END AS gold, CASE WHEN o_orderstatus = 'P' THEN 'ambiguous' ELSE 'primary' END AS split FROM {orders} JOIN {customer} ON o_custkey = c_custkey",
    "votes": "SELECT l_orderkey AS case_id, l_linenumber AS slot, min(CASE CAST(floor(l_quantity) AS INT) % 8 WHEN 0 THEN 'A' WHEN 1 THEN 'A|B' WHEN 2 THEN 'B' WHEN 3 THEN 'B|C' WHEN 4 THEN 'C' WHEN 5 THEN 'C|D' WHEN 6 THEN 'D' ELSE 'Remove' END) AS vote FROM {lineitem} WHERE l_linenumber <= 5 GROUP BY l_orderkey, l_linenumber",
    "attempts": "SELECT event_id, user_id AS execution_id, event_id % 400 AS request_key, ts, CASE event_type WHEN 'error' THEN 'terminal_error' WHEN 'view' THEN 'retry' ELSE 'success' END AS outcome, CASE WHEN event_type = 'signup' THEN 'judge' ELSE 'target' END AS phase, value AS request_wall_ms, props, CAST(event_id % 3 + 1 AS INT) AS attempt_index FROM {events}",
}


def stored(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class _Tables(dict):
    def __init__(self, found: dict) -> None:
        self._found = found

    def __missing__(self, name: str) -> str:
        self._found[name] = None
        return f"{{{name}}}"


def sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """text over stored tables ({name})."""
    needed: dict = {}
    text.format_map(_Tables(needed))
    return spark.sql(text, **{n: stored(spark, sf_dir, n) for n in needed})


def base(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return sql(spark, sf_dir, BASE[name])


class _Names(dict):
    def __missing__(self, name: str) -> str:
        return name


def plain(text: str) -> str:
    """The same text for an engine that knows the stored tables by name."""
    return text.format_map(_Names())


def with_base(names: list[str], body: str) -> str:
    return "WITH " + ", ".join(f"{n} AS ({plain(BASE[n])})" for n in names) + " " + body
