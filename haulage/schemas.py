"""Logical tables, and deterministic views that give the test tables their shapes.

A view's text is read by Spark (with DataFrames for the names in braces) and by any other SQL engine (as
common table expressions), so both see the same rows.
"""

from __future__ import annotations

from string import Formatter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import rank

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

VIEWS = {
    "m_nodes": """
        SELECT s_suppkey AS node_id, s_name AS hostname, CAST(1 + s_suppkey % 16 AS INT) AS cpu_cores,
               CAST((s_suppkey * 37) % 100 AS DOUBLE) / 100 AS cpu_usage, CAST((s_suppkey * 53) % 100 AS DOUBLE) / 100 AS memory_usage,
               CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE (1 + s_suppkey % 10) * 12500000 END AS bandwidth,
               CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE CAST(1 + (s_suppkey * 13) % 200 AS DOUBLE) END AS latency_ms,
               r_name AS region, n_name AS nation, CASE WHEN s_suppkey % 4 = 0 THEN 'true' END AS gpu
        FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey""",
    "m_tasks": """
        SELECT o_orderkey AS task_id, o_orderdate AS submitted_at, 5 - CAST(substr(o_orderpriority, 1, 1) AS INT) AS priority,
               CASE o_custkey % 4 WHEN 0 THEN 'echo' WHEN 1 THEN 'hash' WHEN 2 THEN 'cpu' ELSE 'nonsense' END AS kind,
               o_orderpriority AS payload, o_custkey AS client,
               CASE o_custkey % 5 WHEN 0 THEN 'gpu=true' WHEN 1 THEN 'gpu' WHEN 2 THEN 'gpu!=true' ELSE NULL END AS constraint_text
        FROM {orders}""",
    "m_task_inputs": "SELECT DISTINCT l_orderkey AS task_id, l_partkey AS data_id FROM {lineitem}",
    "m_datasets": "SELECT p_partkey AS data_id, CAST(p_size AS BIGINT) * 1048576 AS size_bytes FROM {part}",
    "m_locations": "SELECT DISTINCT l_partkey AS data_id, l_suppkey AS node_id FROM {lineitem} WHERE l_linenumber <= 1",
    "m_heartbeats": "SELECT event_id, user_id AS node_id, ts, value, event_type FROM {events}",
    "m_blobs": "SELECT doc_id AS blob_id, text FROM {documents}",
    "m_steps": "SELECT conv_id AS run, turn AS step, role AS kind, text AS payload FROM {conversations}",
    "m_edges": "SELECT a.run, a.step AS src, b.step AS dst FROM {m_steps} a JOIN {m_steps} b ON a.run = b.run AND b.step = a.step + 1",
    "m_diamond_edges": """
        SELECT s.run, e.src, e.dst FROM (SELECT run FROM {m_steps} GROUP BY run HAVING max(step) >= 3) s
        CROSS JOIN (SELECT 0 AS src, 1 AS dst UNION ALL SELECT 0, 2 UNION ALL SELECT 1, 3 UNION ALL SELECT 2, 3) e""",
    # the waiting queue: arrival order by day, then id
    "m_queue": """
        SELECT row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS seq, o_orderkey AS task_id,
               5 - CAST(substr(o_orderpriority, 1, 1) AS INT) AS priority, CAST(datediff_days AS BIGINT) AS waited, o_custkey % 3 AS timeout_kind
        FROM (SELECT o_orderkey, o_orderdate, o_orderpriority, o_custkey, CAST(o_orderkey % 400 AS BIGINT) AS datediff_days FROM {orders}) o""",
}


def names(text: str) -> list[str]:
    """The tables and views that a text refers to."""
    return list(dict.fromkeys(n for _, n, _, _ in Formatter().parse(text) if n))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table or view over the Parquet files in sf_dir."""
    if name == "m_queue":
        return _queue(view(spark, sf_dir, "orders"))
    if name in VIEWS:
        return query(spark, sf_dir, VIEWS[name])
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _queue(orders: DataFrame) -> DataFrame:
    """The rows of m_queue; its text numbers all orders in one task, here each day's are numbered by themselves."""
    n = rank.numbered(orders.select("o_orderkey", "o_orderdate", "o_orderpriority", "o_custkey"), F.to_date("o_orderdate"), ["o_orderdate", "o_orderkey"], "n")
    return n.selectExpr("n - 1 AS seq", "o_orderkey AS task_id", "5 - CAST(substr(o_orderpriority, 1, 1) AS INT) AS priority", "CAST(o_orderkey % 400 AS BIGINT) AS waited", "o_custkey % 3 AS timeout_kind")


def query(spark: SparkSession, sf_dir: str, text: str, **given: DataFrame) -> DataFrame:
    """Run a text whose braces name tables, views or given DataFrames."""
    return spark.sql(text, **{n: given.get(n) if n in given else view(spark, sf_dir, n) for n in names(text)})


def portable(text: str, recursive: bool = False) -> str:
    """The same text for another engine: views become common table expressions."""
    order: list[str] = []

    def need(t: str) -> None:
        for n in names(t):
            if n in VIEWS and n not in order:
                need(VIEWS[n])
                order.append(n)

    need(text)
    plain = lambda t: t.format(**{n: n for n in names(t)})
    head = ",\n".join(f"{n} AS ({plain(VIEWS[n])})" for n in order)
    body = plain(text).strip()
    if body.upper().startswith("WITH RECURSIVE "):
        body, recursive = body[15:], True
        return f"WITH RECURSIVE {head + ', ' if head else ''}{body}"
    if body.upper().startswith("WITH "):
        return f"WITH {'RECURSIVE ' if recursive else ''}{head + ', ' if head else ''}{body[5:]}"
    return (f"WITH {head}\n" if head else "") + body
