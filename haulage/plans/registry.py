"""All queries of the engine by name, each with the SQL that another engine can check it by.

A query applies the library's operators to the test tables in their logical shapes (see schemas). Names begin
with the operator's id in the inventory.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import kinds
from ..operators import catalog, content, control, graph, metrics, placement, queueing, state
from ..schemas import names, portable, query, view
from ..sources import config, journal
from ..streaming import monitor

CHUNK = 4096
Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _add(name: str, sql: str | None = None):
    """Register a function of (views by name); sql may name views in braces."""

    def put(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(lambda n: view(spark, sf_dir, n))

        run.__name__ = name
        _QUERIES[name] = run
        if sql is not None:
            _SQL[name] = portable(sql)
        return fn

    return put


def _same(name: str, text: str) -> None:
    """A query whose text both engines read."""
    _QUERIES[name] = lambda spark, sf_dir: query(spark, sf_dir, text)
    _SQL[name] = portable(text)


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _rows(t, text: str) -> DataFrame:
    """Literal rows, as a table that is read and not folded into the plan."""
    return t("m_nodes").sparkSession.sql(text).repartition(1)


def _blobs(t) -> DataFrame:
    return t("m_blobs").select("blob_id", F.col("text").cast("binary").alias("data"))


def _sized_tasks(t) -> DataFrame:
    return t("m_tasks").withColumn("payload_bytes", F.octet_length("payload").cast("long"))


# -- A: content -----------------------------------------------------------------------------------------------


@_add("a1_content_address", "SELECT blob_id, sha256(text) AS data_id, CAST(octet_length(encode(text)) AS BIGINT) AS size_bytes FROM {m_blobs}")
def _(t):
    return content.address(_blobs(t)).drop("data")


@_add("a2_describe", "SELECT sha256(payload) AS data_id, CAST(octet_length(encode(payload)) AS BIGINT) AS size_bytes, CAST(count(*) AS BIGINT) AS n FROM {m_tasks} GROUP BY 1, 2")
def _(t):
    return content.address(t("m_tasks").select(F.col("payload").cast("binary").alias("data"))).groupBy("data_id", "size_bytes").agg(F.count(F.lit(1)).alias("n"))


_IDS = "SELECT blob_id, CASE blob_id % 4 WHEN 0 THEN sha256(text) WHEN 1 THEN substr(sha256(text), 1, 60) WHEN 2 THEN substr(sha256(text), 1, 20) || '+' || substr(sha256(text), 22, 43) ELSE upper(sha256(text)) END AS s FROM {m_blobs}"


@_add("a3_parse_id", f"SELECT blob_id, CASE WHEN length(s) <> 64 THEN 'length ' || length(s) WHEN NOT regexp_full_match(s, '[0-9a-fA-F]+') THEN 'digit in byte ' || (length(regexp_extract(s, '^[0-9a-fA-F]*')) // 2) END AS error FROM ({_IDS})")
def _(t):
    s = F.sha2(F.col("text").cast("binary"), 256)
    r = F.pmod("blob_id", F.lit(4))
    made = F.when(r == 0, s).when(r == 1, F.substring(s, 1, 60)).when(r == 2, F.concat(F.substring(s, 1, 20), F.lit("+"), F.substring(s, 22, 43))).otherwise(F.upper(s))
    return t("m_blobs").select("blob_id", C.id_error(made).alias("error"))


@_add("a4_publish_dedup", f"SELECT sha256(text) AS data_id, CAST(max(octet_length(encode(text))) AS BIGINT) AS size_bytes, CAST(CASE WHEN max(octet_length(encode(text))) > {CHUNK} THEN (max(octet_length(encode(text))) + {CHUNK - 1}) // {CHUNK} ELSE 0 END AS BIGINT) AS n_chunks FROM {{m_blobs}} GROUP BY 1")
def _(t):
    return content.publish(content.address(_blobs(t)), CHUNK)


@_add("a5_verified_insert", "WITH held AS (SELECT DISTINCT sha256(text) AS id FROM {m_blobs} WHERE blob_id % 3 = 0) SELECT b.blob_id, CASE WHEN b.blob_id % 5 = 0 THEN 'mismatch' WHEN h.id IS NOT NULL THEN 'present' ELSE 'new' END AS outcome FROM {m_blobs} b LEFT JOIN held h ON h.id = sha256(b.text)")
def _(t):
    a = content.address(_blobs(t))
    offered = a.withColumn("data_id", F.when(F.col("blob_id") % 5 == 0, F.sha2("data_id", 256)).otherwise(F.col("data_id")))
    return content.verified(offered, a.where("blob_id % 3 = 0")).select("blob_id", "outcome")


_CHUNKS = f"SELECT blob_id, i AS index, encode(text)[i * {CHUNK} + 1 : (i + 1) * {CHUNK}] AS chunk FROM (SELECT blob_id, text, unnest(range(0, CAST((octet_length(encode(text)) + {CHUNK - 1}) // {CHUNK} AS BIGINT))) AS i FROM {{m_blobs}})"


@_add("a6_chunks", f"SELECT blob_id, CAST(index AS BIGINT) AS index, sha256(chunk) AS chunk_id, CAST(octet_length(chunk) AS BIGINT) AS chunk_size FROM ({_CHUNKS})")
def _(t):
    return content.split(_blobs(t), CHUNK).select("blob_id", F.col("index").cast("long").alias("index"), "chunk_id", "chunk_size")


@_add("a7_chunk_range", "SELECT data_id, i AS index, CASE WHEN i * 4194304 < size_bytes THEN i * 4194304 END AS start, CASE WHEN i * 4194304 < size_bytes THEN least((i + 1) * 4194304, size_bytes) END AS stop FROM {m_datasets} CROSS JOIN (SELECT unnest([0, 3, 9]::BIGINT[]) AS i)")
def _(t):
    d = t("m_datasets").select("*", F.explode(F.array(*[F.lit(i).cast("long") for i in (0, 3, 9)])).alias("index"))
    return d.withColumn("r", content.chunk_range(F.col("index"), F.col("size_bytes"), 4194304)).select("data_id", "index", F.col("r.start").alias("start"), F.col("r.end").alias("stop"))


@_add("a8_reassemble", "SELECT sha256(text) AS data_id, 'ok' AS status, sha256(any_value(text)) AS rebuilt_id FROM {m_blobs} WHERE text <> '' GROUP BY 1")
def _(t):
    c = content.split(content.address(_blobs(t)), CHUNK).select("data_id", "index", "chunk", "chunk_id")
    return content.reassemble(c, c.repartition("chunk_id")).select("data_id", "status", C.content_id(F.col("data")).alias("rebuilt_id"))


@_add("a9_missing_chunks", f"SELECT DISTINCT data_id, CAST(i AS BIGINT) AS index FROM (SELECT sha256(text) AS data_id, unnest(range(0, CAST((octet_length(encode(text)) + {CHUNK - 1}) // {CHUNK} AS BIGINT))) AS i FROM {{m_blobs}}) WHERE i % 3 = 1")
def _(t):
    c = content.split(content.address(_blobs(t)), CHUNK).select("data_id", F.col("index").cast("long").alias("index")).distinct()
    return content.missing(c, c.where("index % 3 <> 1"))


@_add("a10_fill_from_store", f"WITH c AS ({_CHUNKS}) SELECT CAST(count(*) AS BIGINT) AS held, CAST(count(DISTINCT blob_id) AS BIGINT) AS blobs FROM c WHERE blob_id >= 100 AND sha256(chunk) IN (SELECT sha256(chunk) FROM c WHERE blob_id < 100)")
def _(t):
    c = content.split(_blobs(t), CHUNK).drop("data", "chunk")
    return content.satisfied_from_store(c.where("blob_id >= 100"), c.where("blob_id < 100")).agg(F.count(F.lit(1)).alias("held"), F.countDistinct("blob_id").alias("blobs"))


@_add("a11_hash_task", "SELECT t.task_id, sha256(t.payload || string_agg(sha256(CAST(i.data_id AS VARCHAR)), '' ORDER BY i.data_id)) AS digest FROM {m_tasks} t JOIN {m_task_inputs} i USING (task_id) GROUP BY t.task_id, t.payload")
def _(t):
    i = t("m_task_inputs").select("task_id", F.col("data_id").cast("int").alias("pos"), F.sha2(F.col("data_id").cast("string").cast("binary"), 256).cast("binary").alias("data"))
    return content.hash_task(t("m_tasks"), i).join(i.select("task_id").distinct(), "task_id", "left_semi")


_same("a12_inventory", "SELECT node_id, data_id, size_bytes FROM {m_locations} JOIN {m_datasets} USING (data_id) ORDER BY node_id, data_id")


@_add("a13_totals", "SELECT CAST(count(*) AS BIGINT) AS datasets, CAST(sum(size_bytes) AS BIGINT) AS bytes FROM {m_datasets} WHERE data_id IN (SELECT data_id FROM {m_locations})")
def _(t):
    return catalog.known(t("m_datasets"), t("m_locations")).agg(F.count(F.lit(1)).alias("datasets"), F.sum("size_bytes").alias("bytes"))


@_add("a18_prometheus", "SELECT 'mesh_node_cpu' AS name, '# HELP mesh_node_cpu CPU load in percent' || chr(10) || '# TYPE mesh_node_cpu gauge' || chr(10) || string_agg('mesh_node_cpu{{node=\"' || node_id || '\"}} ' || CAST(CAST(round(cpu_usage * 100) AS BIGINT) AS VARCHAR), chr(10) ORDER BY 'mesh_node_cpu{{node=\"' || node_id || '\"}} ' || CAST(CAST(round(cpu_usage * 100) AS BIGINT) AS VARCHAR)) || chr(10) AS text FROM {m_nodes}")
def _(t):
    return journal.prometheus(t("m_nodes").select(F.lit("mesh_node_cpu").alias("name"), F.lit("CPU load in percent").alias("help"), F.lit("gauge").alias("kind"), F.concat(F.lit('node="'), "node_id", F.lit('"')).alias("labels"), F.round(F.col("cpu_usage") * 100).cast("long").alias("value")))


@_add("a19_generated", "SELECT CAST((i // 64) % 251 AS INT) AS byte, CAST(count(*) AS BIGINT) AS n FROM range(100000) r(i) GROUP BY 1")
def _(t):
    return journal.blocks(t("m_nodes").sparkSession, 100_000).groupBy("byte").agg(F.count(F.lit(1)).alias("n"))


_LCG = "(((state // 4294967296) * 6364136223846793005 % 4294967296) * 4294967296 + (state % 4294967296) * 6364136223846793005 + 1442695040888963407) % 18446744073709551616"


@_add("a19b_seeded", f"WITH RECURSIVE r(i, state) AS (SELECT -1, (7::HUGEINT * 6364136223846793005 + 1) % 18446744073709551616 UNION ALL SELECT i + 1, {_LCG} FROM r WHERE i < 511), b AS (SELECT i, k, (state >> (8 * k)) & 255 AS v FROM r CROSS JOIN (SELECT unnest(range(8)) AS k) WHERE i >= 0 AND 8 * i + k < 4093) SELECT CAST(8 * i AS BIGINT) AS pos, string_agg(lower(printf('%02X', CAST(v AS INT))), '' ORDER BY k) AS data FROM b GROUP BY i")
def _(t):
    return journal.seeded(t("m_nodes").sparkSession, 7, 4093).select("pos", F.lower(F.hex("data")).alias("data"))


@_add("a17_options", "SELECT * FROM (VALUES ('health', 5), ('probe', 20), ('metrics', 60), ('autoscale', 0)) AS v(name, seconds)")
def _(t):
    return _timers(t)


# -- B: transfers ---------------------------------------------------------------------------------------------


def _rule():
    return placement.label_rule()


def _scored(t, k: int = 1) -> DataFrame:
    return placement.scores(_sized_tasks(t), t("m_nodes"), t("m_task_inputs"), t("m_locations"), t("m_datasets"), _rule(), k=k)


_ELIGIBLE = "SELECT c.constraint_text, n.* FROM (SELECT DISTINCT constraint_text FROM {m_tasks}) c CROSS JOIN {m_nodes} n WHERE CASE WHEN c.constraint_text IS NULL THEN true WHEN c.constraint_text = 'gpu=true' THEN n.gpu IS NOT DISTINCT FROM 'true' WHEN c.constraint_text = 'gpu' THEN n.gpu IS NOT NULL ELSE n.gpu IS DISTINCT FROM 'true' END"
_HELD = "SELECT d.* FROM {m_datasets} d WHERE d.data_id IN (SELECT data_id FROM {m_locations})"
_SCORED = f"""
SELECT task_id, node_id, cpu_usage, memory_usage, compute, transfer, latency, bonus, round(compute + transfer + latency - bonus, 6) AS total FROM (
  SELECT t.task_id, n.node_id, n.cpu_usage, n.memory_usage,
    round(n.cpu_usage * 1.0::DOUBLE + n.memory_usage * 0.5::DOUBLE, 6) AS compute,
    round((greatest(coalesce(tb.total_bytes, 0) - coalesce(lb.local_bytes, 0), 0) + octet_length(encode(t.payload))) / greatest(coalesce(CAST(n.bandwidth AS DOUBLE), 12500000.0::DOUBLE), 1.0::DOUBLE), 6) AS transfer,
    round(coalesce(n.latency_ms, 50.0::DOUBLE) / 1000.0::DOUBLE, 6) AS latency,
    round(CASE WHEN tb.total_bytes > 0 THEN CAST(coalesce(lb.local_bytes, 0) AS DOUBLE) / tb.total_bytes ELSE 0.0::DOUBLE END, 6) AS bonus
  FROM {{m_tasks}} t JOIN ({_ELIGIBLE}) n ON t.constraint_text IS NOT DISTINCT FROM n.constraint_text
  LEFT JOIN (SELECT task_id, CAST(sum(size_bytes) AS BIGINT) AS total_bytes FROM {{m_task_inputs}} JOIN ({_HELD}) USING (data_id) GROUP BY 1) tb ON tb.task_id = t.task_id
  LEFT JOIN (SELECT task_id, node_id, CAST(sum(size_bytes) AS BIGINT) AS local_bytes FROM {{m_task_inputs}} JOIN ({_HELD}) USING (data_id) JOIN {{m_locations}} USING (data_id) GROUP BY 1, 2) lb ON lb.task_id = t.task_id AND lb.node_id = n.node_id)"""
_RANKED = f"SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY total, cpu_usage, memory_usage, node_id) AS rank FROM ({_SCORED})"
_PLACED = f"SELECT task_id, node_id FROM ({_RANKED}) WHERE rank = 1"


def _placed(t) -> DataFrame:
    return placement.cheapest(_scored(t)).select("task_id", "node_id")


_MOVES = f"SELECT p.node_id, i.data_id, count(*) AS requests, any_value(d.size_bytes) AS size_bytes, bool_or(l.node_id IS NOT NULL) AS skipped FROM ({_PLACED}) p JOIN {{m_task_inputs}} i USING (task_id) JOIN {{m_datasets}} d USING (data_id) LEFT JOIN {{m_locations}} l ON l.node_id = p.node_id AND l.data_id = i.data_id GROUP BY 1, 2"


def _moves(t) -> DataFrame:
    return content.transfers(_placed(t), t("m_task_inputs"), t("m_locations"), t("m_datasets"))


@_add("b1_transfers_needed", f"SELECT node_id, data_id, CAST(requests AS BIGINT) AS requests, size_bytes, skipped FROM ({_MOVES})")
def _(t):
    return _moves(t).select("node_id", "data_id", "requests", "size_bytes", "skipped")


@_add("b2_chunk_transfers", f"WITH c AS ({_CHUNKS}), w AS (SELECT blob_id % 10 AS node_id, sha256(chunk) AS chunk_id, min(blob_id * 100000 + index) AS seq FROM c GROUP BY 1, 2) SELECT node_id, chunk_id, CAST(seq AS BIGINT) AS seq FROM w WHERE (node_id, chunk_id) NOT IN (SELECT (blob_id % 10 + 1, sha256(chunk)) FROM c WHERE blob_id % 10 = 0)")
def _(t):
    c = content.split(_blobs(t), CHUNK).select((F.col("blob_id") % 10).alias("node_id"), "chunk_id", (F.col("blob_id") * 100000 + F.col("index")).alias("seq"))
    return content.chunk_transfers(c, c.where("node_id = 0").select(F.lit(1).cast("long").alias("node_id"), "chunk_id"))


@_add("b3_single_flight", f"SELECT CAST(count(*) AS BIGINT) AS moved, CAST(sum(requests) AS BIGINT) AS requests FROM ({_MOVES}) WHERE NOT skipped")
def _(t):
    return _moves(t).where("not skipped").agg(F.count(F.lit(1)).alias("moved"), F.sum("requests").alias("requests"))


@_add("b4_channels", "SELECT node_id, data_id, CAST((row_number() OVER (PARTITION BY node_id ORDER BY data_id) - 1) % 4 AS INT) AS channel FROM {m_locations}")
def _(t):
    return content.channels(t("m_locations"), 4, "data_id").select("node_id", "data_id", "channel")


@_add("b5_codec_choice", "SELECT codec, CAST(count(*) AS BIGINT) AS n FROM (SELECT CASE WHEN octet_length(encode(text)) < 4096 THEN 'none' WHEN bandwidth >= 104857600 THEN 'none' ELSE 'lz4' END AS codec FROM {m_blobs} JOIN {m_nodes} ON node_id = blob_id % 10 + 1) GROUP BY 1")
def _(t):
    b = content.address(_blobs(t)).join(t("m_nodes"), F.col("node_id") == F.col("blob_id") % 10 + 1)
    return b.select(C.codec(F.col("size_bytes"), F.col("bandwidth")).alias("codec")).groupBy("codec").agg(F.count(F.lit(1)).alias("n"))


@_add("b6_compressed")
def _(t):
    return _blobs(t).select("blob_id", F.octet_length("data").cast("long").alias("raw_bytes"), kinds.compressed("data").alias("c")).select("blob_id", "raw_bytes", "c.codec", F.col("c.size").alias("sent_bytes"))


@_add("b7_round_trip", "SELECT blob_id, md5(text) AS digest, CAST(NULL AS VARCHAR) AS error FROM {m_blobs}")
def _(t):
    codec = F.when(F.octet_length("data") < 512, "none").otherwise("lz4")
    sent = _blobs(t).select("blob_id", codec.alias("codec"), kinds.compress(codec, F.col("data")).alias("sent"))
    return sent.select("blob_id", kinds.decompress(F.col("codec"), F.col("sent")).alias("r")).select("blob_id", F.md5("r.data").alias("digest"), "r.error")


@_add("b8_traffic", f"WITH m AS ({_MOVES}) SELECT CAST(sum(CASE WHEN NOT skipped THEN size_bytes ELSE 0 END) AS BIGINT) AS raw_bytes, CAST(sum(CASE WHEN NOT skipped THEN size_bytes // 2 ELSE 0 END) AS BIGINT) AS sent_bytes, CAST(count(*) FILTER (WHERE skipped) AS BIGINT) AS skipped, CAST(sum(CASE WHEN NOT skipped THEN size_bytes - size_bytes // 2 ELSE 0 END) AS BIGINT) AS saved_bytes, CAST(sum(CASE WHEN NOT skipped THEN size_bytes // 2 ELSE 0 END) AS DOUBLE) / CAST(sum(CASE WHEN NOT skipped THEN size_bytes ELSE 0 END) AS DOUBLE) AS ratio FROM m")
def _(t):
    return content.traffic(_moves(t).select("skipped", F.col("size_bytes").alias("raw_bytes"), F.floor(F.col("size_bytes") / 2).alias("sent_bytes")))


@_add("b9_output_retention", f"SELECT sha256('done ' || CAST(task_id AS VARCHAR)) AS data_id, node_id FROM ({_PLACED}) WHERE node_id IS NOT NULL UNION SELECT sha256(CAST(data_id AS VARCHAR)), node_id FROM {{m_locations}}")
def _(t):
    made = _placed(t).select(F.sha2(F.concat(F.lit("done "), F.col("task_id").cast("string")).cast("binary"), 256).alias("data_id"), "node_id")
    return catalog.record(t("m_locations").select(F.sha2(F.col("data_id").cast("string").cast("binary"), 256).alias("data_id"), "node_id"), made)


# -- C: scalars and selection ---------------------------------------------------------------------------------

_PARSED = "SELECT task_id, trim(constraint_text) AS s FROM {m_tasks}"


@_add("c1_constraint_holds", f"SELECT constraint_text, CAST(count(*) AS BIGINT) AS nodes FROM ({_ELIGIBLE}) GROUP BY 1")
def _(t):
    n = t("m_nodes").withColumn("labels", F.when(F.col("gpu").isNotNull(), F.create_map(F.lit("gpu"), F.col("gpu"))).otherwise(F.create_map().cast("map<string,string>")))
    c = t("m_tasks").select("constraint_text").distinct().withColumn("all", F.when(F.col("constraint_text").isNotNull(), F.array(C.parse_constraint(F.col("constraint_text")))))
    return n.crossJoin(c).where(C.satisfies_all(F.col("labels"), F.col("all"))).groupBy("constraint_text").agg(F.count(F.lit(1)).alias("nodes"))  # classes are at most a few


_SPELLED = "SELECT * FROM (VALUES (1, ' gpu = true '), (2, 'a!=b=c'), (3, 'zone'), (4, '=x'), (5, '!=x'), (6, 'k='), (7, ' '), (8, 'a=b!=c')) AS v(id, s)"


def _spelled(t):
    return _rows(t, _SPELLED)


_SPLIT = f"SELECT id, CASE WHEN strpos(trim(s), '!=') > 0 THEN 'ne' WHEN strpos(trim(s), '=') > 0 THEN 'eq' ELSE 'exists' END AS op, CASE WHEN strpos(trim(s), '!=') > 0 THEN trim(substr(trim(s), 1, strpos(trim(s), '!=') - 1)) WHEN strpos(trim(s), '=') > 0 THEN trim(substr(trim(s), 1, strpos(trim(s), '=') - 1)) ELSE trim(s) END AS key, CASE WHEN strpos(trim(s), '!=') > 0 THEN trim(substr(trim(s), strpos(trim(s), '!=') + 2)) WHEN strpos(trim(s), '=') > 0 THEN trim(substr(trim(s), strpos(trim(s), '=') + 1)) END AS value FROM ({_SPELLED})"


@_add("c3_parse_constraints", f"SELECT CAST(id AS BIGINT) AS id, CASE WHEN key <> '' THEN op END AS op, CASE WHEN key <> '' THEN key END AS key, CASE WHEN key <> '' THEN value END AS value FROM ({_SPLIT})")
def _(t):
    return _spelled(t).select(F.col("id").cast("long").alias("id"), C.parse_constraint(F.col("s")).alias("c")).select("id", "c.op", "c.key", "c.value")


@_add("c4_render_constraints", f"SELECT CAST(id AS BIGINT) AS id, CASE WHEN key <> '' THEN key || CASE op WHEN 'ne' THEN '!=' || value WHEN 'eq' THEN '=' || value ELSE '' END END AS s FROM ({_SPLIT})")
def _(t):
    return _spelled(t).select(F.col("id").cast("long").alias("id"), C.render_constraint(C.parse_constraint(F.col("s"))).alias("s"))


@_add("c5_parse_labels", "SELECT node_id, region, nation AS zone FROM {m_nodes}")
def _(t):
    n = t("m_nodes").withColumn("l", C.parse_labels(F.array(F.lit("zone=old"), F.concat(F.lit(" region = "), "region"), F.lit("nothing"), F.lit("=x"), F.concat(F.lit("zone="), "nation"))))
    return n.select("node_id", F.col("l")["region"].alias("region"), F.col("l")["zone"].alias("zone"))


@_add("c6_eligible_count", "SELECT t.task_id, CAST(count(n.node_id) AS BIGINT) AS nodes FROM {m_tasks} t LEFT JOIN (SELECT DISTINCT c.constraint_text, n.node_id FROM (SELECT DISTINCT constraint_text FROM {m_tasks}) c JOIN {m_nodes} n ON c.constraint_text IS NULL OR (c.constraint_text = 'gpu=true' AND n.gpu = 'true') OR (c.constraint_text = 'gpu' AND n.gpu IS NOT NULL) OR (c.constraint_text = 'gpu!=true' AND (n.gpu IS NULL OR n.gpu <> 'true'))) n ON t.constraint_text IS NOT DISTINCT FROM n.constraint_text GROUP BY t.task_id")
def _(t):
    n = placement.eligible(t("m_tasks"), t("m_nodes"), _rule()).groupBy(F.col("constraint_text").alias("c")).agg(F.count(F.lit(1)).alias("n"))
    return t("m_tasks").join(n, F.col("constraint_text").eqNullSafe(F.col("c")), "left").select("task_id", F.coalesce("n", F.lit(0)).cast("long").alias("nodes"))


@_add("c7_available", "SELECT node_id FROM {m_nodes} WHERE node_id % 3 <> 0 AND node_id % 7 <> 1")
def _(t):
    n = t("m_nodes").select("node_id")
    return placement.available(n, n.where("node_id % 3 = 0"), n.where("node_id % 7 <> 1"))


@_add("c8_clamped_metrics", "SELECT node_id, CASE WHEN node_id % 9 = 0 THEN 0.0::DOUBLE ELSE least(greatest(cpu_usage * 3 - 1, 0.0::DOUBLE), 1.0::DOUBLE) END AS cpu, CAST(floor(memory_usage * 16000000000.0::DOUBLE) AS BIGINT) AS used FROM {m_nodes}")
def _(t):
    return t("m_nodes").select("node_id", C.clamp(F.when(F.col("node_id") % 9 == 0, F.lit(float("nan"))).otherwise(F.col("cpu_usage") * 3 - 1)).alias("cpu"), F.floor(F.col("memory_usage") * 16e9).cast("long").alias("used"))


@_add("c9_inflated_load", "SELECT n.node_id, least(1.0::DOUBLE, n.cpu_usage + CAST(coalesce(p.pending, 0) AS DOUBLE) / greatest(n.cpu_cores, 1)) AS cpu_usage FROM {m_nodes} n LEFT JOIN (SELECT client % 50 + 1 AS node_id, count(*) AS pending FROM {m_tasks} GROUP BY 1) p USING (node_id)")
def _(t):
    p = t("m_tasks").groupBy((F.col("client") % 50 + 1).alias("node_id")).agg(F.count(F.lit(1)).alias("pending"))
    return placement.inflate(t("m_nodes"), p).select("node_id", "cpu_usage")


@_add("c10_preview", "SELECT task_id, CASE WHEN octet_length(encode(p)) > 12 THEN regexp_replace(p[1:12], '[^\\x20-\\x7e]', '.', 'g') || '…' ELSE regexp_replace(p, '[^\\x20-\\x7e]', '.', 'g') END AS preview FROM (SELECT task_id, replace(payload, '-', chr(9)) AS p FROM {m_tasks})")
def _(t):
    return t("m_tasks").select("task_id", C.preview(F.translate("payload", "-", "\t").cast("binary"), 12).alias("preview"))


@_add("c11_short_id", "SELECT node_id, split_part(replace(hostname, '#', '-'), '-', 1) AS short FROM {m_nodes}")
def _(t):
    return t("m_nodes").select("node_id", C.short_id(F.translate("hostname", "#", "-")).alias("short"))


@_add("c12_human_bytes", "SELECT data_id, CASE WHEN b < 1024 THEN b || ' B' WHEN b < 1048576 THEN printf('%.1f KiB', b / 1024.0::DOUBLE) WHEN b < 1073741824 THEN printf('%.1f MiB', b / 1048576.0::DOUBLE) ELSE printf('%.1f GiB', b / 1073741824.0::DOUBLE) END AS text FROM (SELECT data_id, CASE data_id % 4 WHEN 0 THEN size_bytes // 1048576 WHEN 1 THEN size_bytes // 128 WHEN 2 THEN size_bytes ELSE size_bytes * 100 END AS b FROM {m_datasets})")
def _(t):
    b, r = F.col("size_bytes"), F.col("data_id") % 4
    n = F.when(r == 0, F.expr("size_bytes div 1048576")).when(r == 1, F.expr("size_bytes div 128")).when(r == 2, b).otherwise(b * 100)
    return t("m_datasets").withColumn("b", n).select("data_id", C.human_bytes(F.col("b")).alias("text"))


_ADDRESSES = "SELECT * FROM (VALUES ('localhost:7000', true), ('127.0.0.1:7000', true), ('127.9.8.7', true), ('[::1]:7000', true), ('::1', true), ('10.0.0.1:7000', false), ('example.org:1', false), ('fe80::1', false), ('1270.0.0.1:5', false)) AS v(address, loopback)"


@_add("c13_loopback", _ADDRESSES)
def _(t):
    return _rows(t, _ADDRESSES).select("address", C.is_loopback(F.col("address")).alias("loopback"))


@_add("c14_rfc3339", "SELECT event_id, strftime(make_timestamp(epoch_us(ts) // 1000000 * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS at FROM {m_heartbeats}")
def _(t):
    return t("m_heartbeats").select("event_id", C.rfc3339(F.expr("unix_micros(cast(ts as timestamp)) div 1000000")).alias("at"))


@_add("c15_ago", "SELECT task_id, CASE WHEN s < 1 THEN 'now' WHEN s < 60 THEN s || 's ago' WHEN s < 3600 THEN (s // 60) || 'm ago' ELSE (s // 3600) || 'h ago' END AS ago FROM (SELECT task_id, (task_id * 37) % 9000 AS s FROM {m_tasks})")
def _(t):
    return t("m_tasks").select("task_id", C.ago((F.col("task_id") * 37) % 9000).alias("ago"))


_FORMS = "SELECT * FROM (VALUES ('gpu, zone=a  x!=1', '25'), ('', 'x'), ('one', '-3')) AS v(s, n)"


@_add("c16_form", "SELECT s, CAST(len(list_filter(string_split_regex(s, '[, ]'), lambda x: x <> '')) AS BIGINT) AS items, TRY_CAST(n AS BIGINT) AS n FROM (SELECT * FROM (VALUES ('gpu, zone=a  x!=1', '25'), ('', 'x'), ('one', '-3')) AS v(s, n))")
def _(t):
    return _rows(t, _FORMS).select("s", F.size(C.split_list(F.col("s"))).cast("long").alias("items"), F.col("n").try_cast("long").alias("n"))


_LEVELS = "SELECT * FROM (VALUES ('CRITICAL', 4), ('', 2), ('urgent', NULL), (' low ', 1), ('Background', 0), ('high', 3), ('normal', 2)) AS v(s, level)"


@_add("c17_priority", f"SELECT s, level, list_extract(['background', 'low', 'normal', 'high', 'critical'], level + 1) AS name, CASE WHEN level IS NOT NULL THEN least(level + 1, 4) END AS promoted FROM ({_LEVELS})")
def _(t):
    p = _rows(t, _LEVELS).select("s", C.priority_level(F.col("s")).alias("level"))
    return p.select("s", "level", C.priority_name(F.col("level")).alias("name"), F.when(F.col("level").isNotNull(), F.least(F.col("level") + 1, F.lit(4))).alias("promoted"))


_MACHINES = "SELECT * FROM (VALUES ('e2-standard-4', 4), ('Standard_D4s_v5', 4), ('Standard_NC24ads_v4', 24), ('f1-micro', 1), ('n2-highmem-128', 128), ('', 1)) AS v(kind, cores)"


@_add("c18_machine_cores", _MACHINES)
def _(t):
    return _rows(t, _MACHINES).select("kind", C.machine_cores(F.col("kind")).alias("cores"))


_same("c19_running", "SELECT node_id, hostname, cpu_cores FROM {m_nodes} WHERE cpu_usage > 0.05 AND latency_ms IS NOT NULL AND region <> 'ASIA'")


@_add("c20_base64", "SELECT task_id, base64(encode(payload)) AS text, octet_length(from_base64(base64(encode(payload)))) = octet_length(encode(payload)) AS round_trip FROM {m_tasks}")
def _(t):
    p = F.col("payload").cast("binary")
    return t("m_tasks").select("task_id", F.base64(p).alias("text"), (F.try_to_binary(F.base64(p), F.lit("base64")) == p).alias("round_trip"))


# -- D: catalog -----------------------------------------------------------------------------------------------


@_add("d1_record_locations", "SELECT data_id, node_id FROM {m_locations} UNION SELECT data_id, data_id % 10 + 1 FROM {m_datasets}")
def _(t):
    return catalog.record(t("m_locations"), t("m_datasets").select("data_id", (F.col("data_id") % 10 + 1).alias("node_id")))


@_add("d2_remove_locations", "SELECT data_id, node_id FROM {m_locations} WHERE (data_id + node_id) % 3 <> 0")
def _(t):
    loc = t("m_locations")
    return catalog.remove(loc, loc.where("(data_id + node_id) % 3 = 0"))


@_add("d3_forget_node", "SELECT CAST(count(*) AS BIGINT) AS left_over, CAST(count(DISTINCT data_id) AS BIGINT) AS datasets FROM {m_locations} WHERE node_id % 4 <> 0")
def _(t):
    left = catalog.forget(t("m_locations"), t("m_nodes").where("node_id % 4 = 0"))
    return left.agg(F.count(F.lit(1)).alias("left_over"), F.countDistinct("data_id").alias("datasets"))


@_add("d4_locations_of", "SELECT d.data_id, CAST(count(l.node_id) AS BIGINT) AS nodes, min(l.node_id) AS first_node FROM {m_datasets} d LEFT JOIN {m_locations} l ON l.data_id = d.data_id GROUP BY d.data_id")
def _(t):
    return catalog.locations_of(t("m_datasets"), t("m_locations"))


@_add("d5_local_bytes", f"SELECT task_id, node_id, CAST(sum(size_bytes) AS BIGINT) AS local_bytes FROM {{m_task_inputs}} JOIN ({_HELD}) USING (data_id) JOIN {{m_locations}} USING (data_id) GROUP BY 1, 2")
def _(t):
    return catalog.local_bytes(t("m_task_inputs"), t("m_locations"), t("m_datasets"))


@_add("d6_held_by", "SELECT n.node_id, CAST(count(l.data_id) AS BIGINT) AS held, CAST(coalesce(sum(d.size_bytes), 0) AS BIGINT) AS held_bytes FROM {m_nodes} n LEFT JOIN {m_locations} l USING (node_id) LEFT JOIN {m_datasets} d USING (data_id) GROUP BY 1")
def _(t):
    return catalog.held_by(t("m_nodes"), t("m_locations"), t("m_datasets"))


@_add("d7_total_bytes", f"SELECT task_id, CAST(sum(size_bytes) AS BIGINT) AS total_bytes FROM {{m_task_inputs}} JOIN ({_HELD}) USING (data_id) GROUP BY 1")
def _(t):
    return catalog.total_bytes(t("m_task_inputs"), t("m_locations"), t("m_datasets"))


@_add("d8_missing_bytes", f"WITH tb AS (SELECT task_id, CAST(sum(size_bytes) AS BIGINT) AS total FROM {{m_task_inputs}} JOIN ({_HELD}) USING (data_id) GROUP BY 1), lb AS (SELECT task_id, node_id, CAST(sum(size_bytes) AS BIGINT) AS here FROM {{m_task_inputs}} JOIN ({_HELD}) USING (data_id) JOIN {{m_locations}} USING (data_id) GROUP BY 1, 2) SELECT task_id, node_id, CAST(greatest(total - here, 0) + octet_length(encode(payload)) AS BIGINT) AS missing_bytes FROM lb JOIN tb USING (task_id) JOIN {{m_tasks}} USING (task_id)")
def _(t):
    here = placement.candidates(_sized_tasks(t).select("task_id", "payload_bytes"), None, t("m_task_inputs"), t("m_locations"), t("m_datasets"))
    return here.select("task_id", "node_id", (F.greatest(F.col("total_bytes") - F.col("local_bytes"), F.lit(0)) + F.col("payload_bytes")).alias("missing_bytes"))


@_add("d9_unknown_inputs", "SELECT task_id, data_id FROM {m_task_inputs} WHERE data_id NOT IN (SELECT data_id FROM {m_locations})")
def _(t):
    return catalog.unknown_inputs(t("m_task_inputs"), t("m_locations")).select("task_id", "data_id")


@_add("d10_announced_again", "SELECT data_id, node_id FROM {m_locations} UNION SELECT data_id, node_id + 1 FROM {m_locations} WHERE node_id % 5 = 0")
def _(t):
    loc = t("m_locations")
    return catalog.record(loc, loc.where("node_id % 5 = 0").select("data_id", (F.col("node_id") + 1).alias("node_id")))


@_add("d11_evicted", "SELECT data_id, node_id FROM {m_locations} WHERE NOT (data_id % 6 = 0 AND node_id % 2 = 0)")
def _(t):
    return catalog.remove(t("m_locations"), t("m_locations").where("data_id % 6 = 0 and node_id % 2 = 0"))


@_add("d12_mesh_check", "SELECT 'missing host ' || min(replace(hostname, '#', '?')) AS error FROM {m_nodes} WHERE node_id % 5 = 0")
def _(t):
    n = t("m_nodes").select("hostname", F.col("region").alias("label"), "node_id")
    wanted = n.withColumn("hostname", F.when(F.col("node_id") % 5 == 0, F.translate("hostname", "#", "?")).otherwise(F.col("hostname")))
    return catalog.mesh_check(wanted, n)


@_add("d13_node_summary", "SELECT n.node_id, n.hostname, CAST(count(l.data_id) AS BIGINT) AS held, CAST(coalesce(sum(d.size_bytes), 0) AS BIGINT) AS held_bytes, n.node_id % 3 <> 0 AS connected FROM {m_nodes} n LEFT JOIN {m_locations} l USING (node_id) LEFT JOIN {m_datasets} d USING (data_id) GROUP BY 1, 2")
def _(t):
    n = t("m_nodes").select("node_id", "hostname")
    return catalog.node_summary(n, t("m_locations"), t("m_datasets"), n.where("node_id % 3 <> 0"))


@_add("d14_identify", "SELECT task_id, CASE client % 4 WHEN 0 THEN NULL WHEN 1 THEN 'shared' WHEN 2 THEN 'team-b' END AS who, CASE client % 4 WHEN 0 THEN 'missing' WHEN 3 THEN 'invalid' ELSE 'ok' END AS verdict FROM {m_tasks}")
def _(t):
    r = F.col("client") % 4
    tasks = t("m_tasks").select("task_id", F.when(r == 1, "t1").when(r == 2, "t2").when(r == 3, "t9").alias("token"))
    tokens = tasks.sparkSession.sql("SELECT * FROM VALUES (1, 't1', 'shared'), (2, 't2', 'team-a'), (3, 't2', 'team-b') AS v(no, token, who)")
    return catalog.identify(tasks, tokens).select("task_id", "who", "verdict")


_same("d15_correlated_replies", "SELECT q.event_id AS asked, min(r.event_id) AS answered FROM {m_heartbeats} q JOIN {m_heartbeats} r ON r.node_id = q.node_id AND r.event_type <> q.event_type AND r.ts > q.ts AND r.ts <= q.ts + INTERVAL '10' MINUTE GROUP BY q.event_id")


# -- E: placement ---------------------------------------------------------------------------------------------


@_add("e1_place_least_loaded", f"SELECT t.task_id, b.node_id FROM {{m_tasks}} t LEFT JOIN (SELECT constraint_text, node_id FROM (SELECT *, row_number() OVER (PARTITION BY constraint_text ORDER BY cpu_usage, memory_usage, node_id) AS r FROM ({_ELIGIBLE})) WHERE r = 1) b ON t.constraint_text IS NOT DISTINCT FROM b.constraint_text")
def _(t):
    return placement.least_loaded(t("m_tasks"), t("m_nodes"), _rule())


@_add("e2_place_locality", f"SELECT task_id, node_id, local_bytes FROM (SELECT t.task_id, n.node_id, coalesce(lb.local_bytes, 0) AS local_bytes, row_number() OVER (PARTITION BY t.task_id ORDER BY coalesce(lb.local_bytes, 0) DESC, n.cpu_usage, n.memory_usage, n.node_id) AS r FROM {{m_tasks}} t JOIN ({_ELIGIBLE}) n ON t.constraint_text IS NOT DISTINCT FROM n.constraint_text LEFT JOIN (SELECT task_id, node_id, CAST(sum(size_bytes) AS BIGINT) AS local_bytes FROM {{m_task_inputs}} JOIN ({_HELD}) USING (data_id) JOIN {{m_locations}} USING (data_id) GROUP BY 1, 2) lb ON lb.task_id = t.task_id AND lb.node_id = n.node_id) WHERE r = 1")
def _(t):
    return placement.by_locality(t("m_tasks"), t("m_nodes"), t("m_task_inputs"), t("m_locations"), t("m_datasets"), _rule())


@_add("e3_score_terms", f"WITH s AS ({_SCORED}) SELECT task_id, node_id, compute, transfer, latency, bonus, total FROM s WHERE bonus > 0")
def _(t):
    return _scored(t, k=0).where("bonus > 0").select("task_id", "node_id", "compute", "transfer", "latency", "bonus", "total")


@_add("e4_place_advanced", f"SELECT task_id, node_id, compute, transfer, latency, bonus, total FROM ({_RANKED}) WHERE rank = 1")
def _(t):
    return placement.cheapest(_scored(t))


@_add("e5_unplaced", "SELECT task_id FROM {m_tasks} WHERE constraint_text IN ('gpu', 'gpu=true')")
def _(t):
    some = t("m_nodes").where("gpu is null")
    return placement.least_loaded(t("m_tasks"), some, _rule()).where("node_id is null").select("task_id")


def _attempt(tasks: str, locations: str, tried: str = "") -> str:
    scored = _SCORED.replace("{m_tasks}", tasks).replace("{m_locations}", locations)
    return f"SELECT task_id, node_id FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY total, cpu_usage, memory_usage, node_id) AS r FROM ({scored}) s {tried}) WHERE r = 1"


_RETRIES = f"""
WITH b1 AS ({_attempt("{m_tasks}", "{m_locations}")}), f1 AS (SELECT * FROM b1 WHERE node_id % 3 = 0),
t2 AS (SELECT * FROM {{m_tasks}} WHERE task_id IN (SELECT task_id FROM f1)), l2 AS (SELECT * FROM {{m_locations}} WHERE node_id NOT IN (SELECT node_id FROM f1)),
b2 AS ({_attempt("t2", "l2", "ANTI JOIN f1 USING (task_id, node_id)")}), f2 AS (SELECT * FROM b2 WHERE node_id % 3 = 0),
t3 AS (SELECT * FROM t2 WHERE task_id IN (SELECT task_id FROM f2)), l3 AS (SELECT * FROM l2 WHERE node_id NOT IN (SELECT node_id FROM f2)),
b3 AS ({_attempt("t3", "l3", "ANTI JOIN (SELECT * FROM f1 UNION ALL SELECT * FROM f2) USING (task_id, node_id)")})
SELECT t.task_id, CASE WHEN b1.node_id % 3 <> 0 THEN b1.node_id WHEN b2.node_id % 3 <> 0 THEN b2.node_id WHEN b3.node_id % 3 <> 0 THEN b3.node_id END AS node_id,
  CAST((b1.node_id IS NOT NULL)::INT + (b2.node_id IS NOT NULL)::INT + (b3.node_id IS NOT NULL)::INT AS BIGINT) AS attempts
FROM {{m_tasks}} t LEFT JOIN b1 USING (task_id) LEFT JOIN b2 USING (task_id) LEFT JOIN b3 USING (task_id)"""


@_add("e6_retry_rank", _RETRIES)
def _(t):
    return placement.place_with_retries(_sized_tasks(t), t("m_nodes"), t("m_task_inputs"), t("m_locations"), t("m_datasets"), _rule(), F.col("node_id") % 3 == 0)


@_add("e7_spread")
def _(t):
    return placement.spread(t("m_tasks"), t("m_nodes"), rule=_rule())


# -- F: aggregates --------------------------------------------------------------------------------------------


@_add("f1_mean_load", "SELECT round(coalesce(avg(cpu_usage), 0), 6) AS cpu, round(coalesce(avg(memory_usage), 0), 6) AS memory, CAST(count(*) FILTER (WHERE node_id % 3 <> 0) AS BIGINT) AS connected FROM {m_nodes}")
def _(t):
    return t("m_nodes").agg(F.round(metrics.mean_or_zero("cpu_usage"), 6).alias("cpu"), F.round(metrics.mean_or_zero("memory_usage"), 6).alias("memory"), F.count_if(F.col("node_id") % 3 != 0).alias("connected"))


_same("f2_counters", "SELECT event_type, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT node_id) AS BIGINT) AS nodes FROM {m_heartbeats} GROUP BY event_type")
_same("f3_queue_stats", "SELECT CAST(sum(CASE WHEN waited < 300 THEN 1 ELSE 0 END) AS BIGINT) AS dequeued, CAST(sum(CASE WHEN waited >= 350 THEN 1 ELSE 0 END) AS BIGINT) AS expired, round(coalesce(avg(waited), 0), 6) AS mean_wait, max(waited) AS max_wait FROM {m_queue}")


@_add("f4_lcg", "WITH RECURSIVE r(n, i, acc) AS (SELECT n, 0::HUGEINT, 0::HUGEINT FROM (SELECT unnest([0, 1, 2, 100, 257]) AS n) UNION ALL SELECT n, i + 1, (((acc // 4294967296) * 6364136223846793005 % 4294967296) * 4294967296 + (acc % 4294967296) * 6364136223846793005 + i) % 18446744073709551616 FROM r WHERE i < n) SELECT CAST(n AS INT) AS n, CAST(acc AS VARCHAR) AS acc FROM r WHERE i = n")
def _(t):
    n = t("m_nodes").sparkSession.sql("SELECT explode(array(0, 1, 2, 100, 257)) AS n")
    return n.select("n", C.lcg_fold(F.col("n")).cast("string").alias("acc"))


@_add("f5_percentiles", "SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99 FROM {m_heartbeats} GROUP BY 1")
def _(t):
    return t("m_heartbeats").groupBy("event_type").agg(*[metrics.percentile("value", q).alias(f"p{int(q * 100)}") for q in (0.5, 0.95, 0.99)])


@_add("f5b_percentile_by_rank", "SELECT event_type, list_sort(array_agg(value))[CAST(greatest(1, least(floor(count(*) * 0.95::DOUBLE + 0.999::DOUBLE), count(*))) AS BIGINT)] AS p95 FROM {m_heartbeats} GROUP BY 1")
def _(t):
    return t("m_heartbeats").groupBy("event_type").agg(metrics.percentile_by_rank("value", 0.95).alias("p95"))


@_add("f6_throughput", "SELECT event_type, CASE WHEN sum(value) > 0 THEN round(CAST(count(*) AS DOUBLE) / sum(value), 6) ELSE 0.0::DOUBLE END AS per_second, round(sum(value) / greatest(count(*), 1), 6) AS mean FROM {m_heartbeats} GROUP BY 1")
def _(t):
    g = t("m_heartbeats").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("s"))
    return g.select("event_type", F.round(metrics.per_second(F.col("n"), F.col("s")), 6).alias("per_second"), F.round(F.col("s") / F.greatest(F.col("n"), F.lit(1)), 6).alias("mean"))


_REPORTS = "SELECT * FROM (VALUES ('gate', 8388608, 1048576), ('network', 83886080, 4194304), ('in_process', 839291600, 477569), ('worse', 100, 150), ('nothing', 0, 5)) AS v(name, baseline, optimized)"


@_add("f8_reduction", f"SELECT name, CASE WHEN baseline > 0 THEN round(CAST(baseline - optimized AS DOUBLE) / baseline * 100, 4) ELSE 0.0::DOUBLE END AS percent, CASE WHEN optimized > 0 THEN round(CAST(baseline AS DOUBLE) / optimized, 4) ELSE 0.0::DOUBLE END AS speedup FROM ({_REPORTS})")
def _(t):
    r = _rows(t, _REPORTS)
    return r.select("name", F.round(metrics.reduction(F.col("baseline"), F.col("optimized")), 4).alias("percent"), F.round(metrics.speedup(F.col("baseline"), F.col("optimized")), 4).alias("speedup"))


@_add("f9_snapshot_difference", "SELECT a.node_id, CAST(greatest(a.n - coalesce(b.n, 0), 0) AS BIGINT) AS n, CAST(greatest(a.total - coalesce(b.total, 0), 0) AS BIGINT) AS total FROM (SELECT node_id, count(*) AS n, sum(event_id) AS total FROM {m_heartbeats} GROUP BY 1) a LEFT JOIN (SELECT node_id, count(*) * 2 AS n, sum(event_id) AS total FROM {m_heartbeats} WHERE event_id % 2 = 0 GROUP BY 1) b USING (node_id)")
def _(t):
    h = t("m_heartbeats")
    after = h.groupBy("node_id").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("total"))
    before = h.where("event_id % 2 = 0").groupBy("node_id").agg((F.count(F.lit(1)) * 2).alias("n"), F.sum("event_id").alias("total"))
    return metrics.difference(after, before, "node_id", ["n", "total"])


@_add("f10_nodes_used", f"SELECT CAST(count(DISTINCT node_id) AS BIGINT) AS nodes FROM ({_PLACED})")
def _(t):
    return _placed(t).agg(F.countDistinct("node_id").alias("nodes"))


_same("f11_placement_stats", "SELECT e.run, e.dst AS step, CAST(sum(CASE WHEN (e.src + e.run) % 3 = (e.dst + e.run) % 3 THEN 1 ELSE 0 END) AS BIGINT) AS local_inputs, CAST(sum(CASE WHEN (e.src + e.run) % 3 <> (e.dst + e.run) % 3 THEN 1 ELSE 0 END) AS BIGINT) AS moved_inputs, CAST(sum(length(s.payload)) AS BIGINT) AS input_chars FROM {m_edges} e JOIN {m_steps} s ON s.run = e.run AND s.step = e.src GROUP BY e.run, e.dst")
_same("f12_tally", "SELECT client, CAST(sum(CASE WHEN kind <> 'nonsense' THEN 1 ELSE 0 END) AS BIGINT) AS good, CAST(sum(CASE WHEN kind = 'nonsense' THEN 1 ELSE 0 END) AS BIGINT) AS bad, bool_and(kind <> 'nonsense') AS success FROM {m_tasks} GROUP BY client")


@_add("f13_cache_counts", "SELECT CAST(count(*) FILTER (WHERE r > 1) AS BIGINT) AS hits, CAST(count(*) FILTER (WHERE r = 1) AS BIGINT) AS misses FROM (SELECT row_number() OVER (PARTITION BY kind, payload ORDER BY task_id) AS r FROM {m_tasks} WHERE kind <> 'nonsense')")
def _(t):
    w = t("m_tasks").where("kind <> 'nonsense'").withColumn("seq", F.col("task_id")).withColumn("success", F.lit(True))
    return state.cache_hits(w, ["kind", "payload"]).agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"))


_same("f14_spread", "SELECT node_id, CAST(count(*) AS BIGINT) AS beats, round(sum(value), 4) AS work FROM {m_heartbeats} GROUP BY node_id")


@_add("f15_first_and_median", "SELECT node_id, arg_min(value, event_id) AS first, median(value) AS median FROM {m_heartbeats} GROUP BY 1")
def _(t):
    return t("m_heartbeats").groupBy("node_id").agg(F.min_by("value", "event_id").alias("first"), F.median("value").alias("median"))


@_add("f16_span_counts", "SELECT event_type AS name, CAST(count(*) AS BIGINT) AS n FROM {m_heartbeats} GROUP BY 1")
def _(t):
    body = F.format_string('{"resourceSpans":[{"scopeSpans":[{"spans":[{"name":"%s"}]}]}]}', F.col("event_type"))
    return metrics.span_counts(t("m_heartbeats").select(body.alias("body")))


@_add("f17_warnings", f"SELECT name, CASE WHEN baseline = 0 THEN 'the baseline moved nothing' WHEN optimized % 7 >= 5 THEN 'every transfer was skipped' ELSE '' END AS warnings FROM ({_REPORTS})")
def _(t):
    return _rows(t, _REPORTS).select("name", F.array_join(metrics.warnings(F.col("baseline"), F.col("optimized") % 7, F.lit(5)), ", ").alias("warnings"))


# -- G: sequences ---------------------------------------------------------------------------------------------

_RATES = "SELECT event_id, node_id, coalesce(CASE WHEN u - lag(u) OVER w > 0 THEN CAST(floor(CAST(greatest(event_id - lag(event_id) OVER w, 0) * 1000000 AS DOUBLE) / (u - lag(u) OVER w)) AS BIGINT) END, 0) AS rate, u FROM (SELECT *, epoch_us(ts) AS u FROM {m_heartbeats}) WINDOW w AS (PARTITION BY node_id ORDER BY u, event_id)"


def _beats(t) -> DataFrame:
    return t("m_heartbeats").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))


@_add("g1_rates", f"SELECT event_id, node_id, CAST(rate AS BIGINT) AS rate FROM ({_RATES})")
def _(t):
    return metrics.rates(_beats(t).withColumn("total", F.col("event_id")), "node_id", "at", "total").select("event_id", "node_id", "rate")


@_add("g2_peak", f"SELECT event_id, CAST(max(rate) OVER (PARTITION BY node_id ORDER BY u, event_id ROWS BETWEEN 119 PRECEDING AND CURRENT ROW) AS BIGINT) AS peak FROM ({_RATES})")
def _(t):
    return metrics.rates(_beats(t).withColumn("total", F.col("event_id")), "node_id", "at", "total").select("event_id", "peak")


@_add("g3_ewma", "WITH RECURSIVE a AS (SELECT node_id, value, row_number() OVER (PARTITION BY node_id ORDER BY ts, event_id) AS r FROM {m_heartbeats}), e(node_id, r, x) AS (SELECT node_id, r, value FROM a WHERE r = 1 UNION ALL SELECT a.node_id, a.r, e.x * (1 - 0.3::DOUBLE) + a.value * 0.3::DOUBLE FROM e JOIN a ON a.node_id = e.node_id AND a.r = e.r + 1) SELECT node_id, round(arg_max(x, r), 6) AS ewma, CAST(max(r) AS BIGINT) AS n FROM e GROUP BY 1")
def _(t):
    return metrics.ewma(_beats(t), "node_id", ["at", "event_id"], "value").select("node_id", F.round("ewma", 6).alias("ewma"), "n")


@_add("g4_link_estimate", "SELECT node_id, latency_ms AS small, CASE WHEN cpu_usage * 10 > 1 THEN round(1048576 / (cpu_usage * 10 / 1000), 3) END AS bandwidth FROM {m_nodes} WHERE latency_ms IS NOT NULL AND abs(cpu_usage * 10 - 1) > 0.001")
def _(t):
    n = t("m_nodes").where("latency_ms is not null and abs(cpu_usage * 10 - 1) > 0.001")
    n = n.withColumn("l", metrics.link(F.lit(0.0), F.col("cpu_usage") * 10, F.lit(1048576)))
    return n.select("node_id", F.col("latency_ms").alias("small"), F.round("l.bandwidth", 3).alias("bandwidth"))


_same("g5_arrival_number", "SELECT event_id, CAST(row_number() OVER (PARTITION BY node_id ORDER BY ts, event_id) AS BIGINT) AS n FROM {m_heartbeats}")


@_add("g6_recent", "SELECT event_id AS task_id, ts AS at FROM {m_heartbeats} ORDER BY ts DESC, event_id DESC LIMIT 20")
def _(t):
    return metrics.recent(t("m_heartbeats").select(F.col("event_id").alias("task_id"), F.col("ts").alias("at")))


_same("g7_history", "SELECT node_id, event_id FROM (SELECT node_id, event_id, row_number() OVER (PARTITION BY node_id ORDER BY ts DESC, event_id DESC) AS r FROM {m_heartbeats}) x WHERE r <= 64")


@_add("g8_pacing", "WITH b AS (SELECT *, CASE WHEN event_type = 'purchase' OR coalesce(abs(value - lag(value) OVER w) >= 10, true) THEN 1 ELSE 0 END AS reset FROM {m_heartbeats} WINDOW w AS (PARTITION BY node_id ORDER BY ts, event_id)), i AS (SELECT *, sum(reset) OVER (PARTITION BY node_id ORDER BY ts, event_id) AS island FROM b) SELECT event_id, CAST(least(5 * power(2, row_number() OVER (PARTITION BY node_id, island ORDER BY ts, event_id) - 1), 15) AS DOUBLE) AS gap FROM i")
def _(t):
    b = _beats(t).withColumn("worked", F.col("event_type") == "purchase").withColumn("load", F.col("value"))
    return metrics.pacing(b, 5, 15, 10.0).select("event_id", "gap")


@_add("g9_backoff", "SELECT CAST(a AS BIGINT) AS attempt, CAST(c AS BIGINT) AS ceiling, CASE WHEN c > 0 THEN CAST(least(power(2, a - 1), c) AS DOUBLE) END AS delay FROM range(1, 12) x(a) CROSS JOIN (SELECT unnest([0, 30, 300]) AS c)")
def _(t):
    a = t("m_nodes").sparkSession.range(1, 12).select(F.col("id").alias("attempt"), F.explode(F.array(*[F.lit(x).cast("long") for x in (0, 30, 300)])).alias("ceiling"))
    return a.withColumn("delay", C.backoff(F.col("attempt"), F.col("ceiling")))


_STATUSES = "SELECT * FROM (VALUES (200, 'ok'), (401, 'unauthorized'), (403, 'unauthorized'), (404, 'not_found'), (429, 'throttled'), (500, 'unavailable'), (503, 'unavailable'), (418, 'request')) AS v(status, class)"


@_add("g10_http_retry", f"SELECT status, class IN ('throttled', 'unavailable') AS again, CASE WHEN class IN ('throttled', 'unavailable') THEN CAST(a AS BIGINT) END AS attempt, CASE WHEN class IN ('throttled', 'unavailable') THEN CAST(0.2::DOUBLE * power(2, a - 1) AS DOUBLE) END AS delay FROM ({_STATUSES}) CROSS JOIN range(1, 4) x(a)")
def _(t):
    s = _rows(t, _STATUSES).select("status", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("a"))
    again = C.http_class(F.col("status")).isin("throttled", "unavailable")
    return s.select("status", again.alias("again"), F.when(again, F.col("a").cast("long")).alias("attempt"), F.when(again, C.backoff(F.col("a"), F.lit(100), 0.2)).alias("delay"))


# -- H: queue -------------------------------------------------------------------------------------------------

_AGED = "SELECT *, least(4, priority + waited // 100) AS effective FROM {m_queue}"


@_add("h1_effective_priority", f"SELECT task_id, CAST(effective AS INT) AS effective FROM ({_AGED})")
def _(t):
    return queueing.aged(t("m_queue"), 100).select("task_id", "effective")


@_add("h2_pop_order", f"SELECT task_id, CAST(row_number() OVER (ORDER BY effective DESC, seq) AS BIGINT) AS place FROM ({_AGED})")
def _(t):
    return queueing.pop_order(t("m_queue"), 100).select("task_id", "place")


@_add("h2b_next_up", f"SELECT task_id FROM ({_AGED}) ORDER BY effective DESC, seq LIMIT 10")
def _(t):
    return queueing.next_up(t("m_queue"), 100, 10).select("task_id")


@_add("h3_expired", "SELECT task_id FROM {m_queue} WHERE CASE timeout_kind WHEN 0 THEN waited >= 250 WHEN 1 THEN waited >= 50 ELSE false END")
def _(t):
    own = F.when(F.col("timeout_kind") == 1, 50).when(F.col("timeout_kind") == 2, 0)
    return queueing.expired(t("m_queue"), own, 250).select("task_id")


@_add("h4_reject", "SELECT task_id, seq < 500 AS admitted FROM {m_queue}")
def _(t):
    return queueing.admit_reject(t("m_queue"), 500).select("task_id", "admitted")


@_add("h5_drop_oldest", "SELECT task_id, seq > (SELECT max(seq) FROM {m_queue}) - 500 AS admitted FROM {m_queue}")
def _(t):
    return queueing.admit_drop_oldest(t("m_queue"), 500).select("task_id", "admitted")


@_add("h6_drop_lowest", "SELECT client, CAST(priority AS INT) AS priority, CAST(count(*) AS BIGINT) AS n FROM (SELECT client % 32 AS client, priority, row_number() OVER (PARTITION BY client % 32 ORDER BY priority DESC) AS r FROM {m_tasks}) WHERE r <= 20 GROUP BY 1, 2")
def _(t):
    b = t("m_tasks").select((F.col("client") % 32).alias("client"), F.col("task_id").alias("seq"), "task_id", "priority", F.lit(0).cast("long").alias("at"))
    kept = queueing.admit_drop_lowest(b, "client", 20).where("fate = 'held'")
    return kept.join(t("m_tasks").select("task_id", "priority"), "task_id").groupBy("client", "priority").agg(F.count(F.lit(1)).alias("n"))


@_add("h7_depth", "SELECT CAST(l AS INT) AS priority, CAST(count(q.task_id) AS BIGINT) AS n FROM range(5) r(l) LEFT JOIN {m_queue} q ON q.priority = l GROUP BY 1")
def _(t):
    return queueing.depth(t("m_queue"))


@_add("h8_oldest_wait", "SELECT coalesce(max(waited), 0) AS oldest_wait FROM {m_queue}")
def _(t):
    return queueing.oldest_wait(t("m_queue"))


_same("h9_node_order", "SELECT hostname, node_id, CAST(row_number() OVER (PARTITION BY region ORDER BY hostname, node_id) AS BIGINT) AS place FROM {m_nodes}")


@_add("h10_simulated_queue")
def _(t):
    a = t("m_queue").select((F.col("seq") % 64).alias("lane"), "seq", "task_id", "priority", F.expr("seq div 64 * 3").alias("at"))
    return queueing.simulate(a, "lane", 20, 30, 5)


# -- I: state -------------------------------------------------------------------------------------------------


def _accesses(t) -> DataFrame:
    return t("m_task_inputs").join(t("m_datasets"), "data_id").select((F.col("task_id") % 64).alias("node_id"), (F.col("task_id") * 100_000 + F.col("data_id")).alias("seq"), "data_id", "size_bytes")


@_add("i1_lru")
def _(t):
    return state.lru(_accesses(t), 256 << 20)


@_add("i2_result_cache", "SELECT task_id, coalesce(max(CASE WHEN kind <> 'nonsense' THEN 1 ELSE 0 END) OVER (PARTITION BY kind, payload, client ORDER BY task_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 1, false) AS hit FROM {m_tasks}")
def _(t):
    w = t("m_tasks").withColumn("seq", F.col("task_id")).withColumn("success", F.col("kind") != "nonsense")
    return state.cache_hits(w, ["kind", "payload", "client"]).select("task_id", "hit")


@_add("i2b_bounded_cache")
def _(t):
    w = t("m_tasks").select((F.col("client") % 64).alias("lane"), F.col("task_id").alias("seq"), F.concat("kind", "payload").alias("work_key"), (F.col("kind") != "nonsense").alias("success"))
    return state.bounded_cache(w, "lane", 8, 5000)


@_add("i3_registry", "SELECT node_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM {m_heartbeats} GROUP BY 1")
def _(t):
    return state.latest(t("m_heartbeats").select("node_id", "ts", "event_id", "event_type"), "node_id", ["ts", "event_id"]).select("node_id", "event_id", "event_type")


@_add("i4_unregistered", "SELECT event_id, node_id FROM {m_heartbeats} WHERE node_id NOT IN (SELECT node_id FROM {m_nodes})")
def _(t):
    return state.unregistered(t("m_heartbeats"), t("m_nodes")).select("event_id", "node_id")


@_add("i5_stale", "SELECT node_id, max(ts) AS last_seen FROM {m_heartbeats} GROUP BY 1 HAVING epoch_us((SELECT max(ts) FROM {m_heartbeats})) - epoch_us(max(ts)) > 86400000000")
def _(t):
    return state.stale(t("m_heartbeats"), 86_400)


@_add("i6_current_locations", "WITH r AS (SELECT node_id, max(event_id) AS reset FROM {m_heartbeats} WHERE event_type = 'purchase' GROUP BY 1) SELECT DISTINCT l.data_id, l.node_id FROM {m_locations} l LEFT JOIN r USING (node_id) WHERE reset IS NULL OR l.data_id >= reset")
def _(t):
    resets = t("m_heartbeats").where("event_type = 'purchase'").select("node_id", F.col("event_id").alias("at"))
    return state.current_locations(t("m_locations").withColumn("at", F.col("data_id")), resets)


@_add("i7_resume", "SELECT run, step, CASE WHEN step % 4 = 3 THEN 'todo' WHEN run % 5 = 0 THEN 'changed' WHEN (run + step) % 3 = 0 THEN 'lost' ELSE 'done' END AS state FROM {m_steps}")
def _(t):
    s = t("m_steps").select("run", "step", F.sha2(F.col("payload").cast("binary"), 256).alias("fingerprint"))
    out = F.concat_ws("/", "run", "step")
    had = s.where("step % 4 <> 3")
    log = had.select("run", "step", F.lit("old").alias("fingerprint"), out.alias("output_id"), F.lit(1).alias("line")).unionByName(had.select("run", "step", F.when(F.col("run") % 5 == 0, F.lit("other")).otherwise(F.col("fingerprint")).alias("fingerprint"), out.alias("output_id"), F.lit(2).alias("line")))
    kept = s.where("(run + step) % 3 <> 0").select(out.alias("output_id"))
    return state.completed(log, s, kept)


@_add("i8_fingerprint", "SELECT run, sha256(string_agg(CAST(octet_length(encode(kind || '|' || payload)) AS VARCHAR) || ':' || kind || '|' || payload, '' ORDER BY step)) AS fingerprint FROM {m_steps} GROUP BY 1")
def _(t):
    return state.fingerprint(t("m_steps"), F.concat("kind", F.lit("|"), "payload"))


# -- J: graphs ------------------------------------------------------------------------------------------------

_DIAMOND_STEPS = "SELECT DISTINCT run, src AS step FROM {m_diamond_edges} UNION SELECT run, dst FROM {m_diamond_edges}"


def _diamond(t) -> tuple[DataFrame, DataFrame]:
    e = t("m_diamond_edges")
    return e.select("run", F.col("src").alias("step")).union(e.select("run", "dst")).distinct(), e


@_add("j1_validate", "SELECT run, CAST(min(dst) AS BIGINT) AS step, CASE WHEN run % 2 = 0 THEN 'unknown' ELSE 'self' END AS fault FROM {m_edges} WHERE run % 3 = 0 AND dst >= 2 GROUP BY run")
def _(t):
    e = t("m_edges")
    src = F.when((F.col("run") % 3 == 0) & (F.col("dst") >= 2), F.when(F.col("run") % 2 == 0, F.lit(99)).otherwise(F.col("dst"))).otherwise(F.col("src"))
    return graph.faults(t("m_steps"), e.select("run", src.alias("src"), "dst"))


@_add("j1b_cycles", "SELECT s.run, s.step FROM {m_steps} s JOIN (SELECT run FROM {m_steps} GROUP BY run HAVING max(step) >= 2) c ON c.run = s.run WHERE s.run % 2 = 0")
def _(t):
    s, e = t("m_steps"), t("m_edges")
    back = s.groupBy("run").agg(F.max("step").alias("src")).where("src >= 2 and run % 2 = 0").select("run", "src", F.lit(0).cast("long").alias("dst"))
    return graph.stuck(s, e.unionByName(back))


@_add("j2_topological", "SELECT run, CAST(step AS BIGINT) AS step, CAST(step AS BIGINT) AS place FROM {m_steps}")
def _(t):
    return queueing.topological(t("m_edges"), t("m_steps"))


@_add("j3_waves", f"SELECT run, CAST(step AS INT) AS step, CAST(CASE step WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END AS INT) AS wave FROM ({_DIAMOND_STEPS})")
def _(t):
    return graph.waves(*_diamond(t))


@_add("j3b_chain_waves", "WITH RECURSIVE w(run, step, wave) AS (SELECT run, min(step), 0 FROM {m_steps} GROUP BY run UNION ALL SELECT e.run, e.dst, w.wave + 1 FROM w JOIN {m_edges} e ON e.run = w.run AND e.src = w.step) SELECT run, step, CAST(max(wave) AS INT) AS wave FROM w GROUP BY run, step")
def _(t):
    return graph.waves(t("m_steps"), t("m_edges"))


@_add("j4_roots", "SELECT run, step FROM {m_steps} s WHERE NOT EXISTS (SELECT 1 FROM {m_edges} e WHERE e.run = s.run AND e.dst = s.step)")
def _(t):
    return graph.roots(t("m_steps"), t("m_edges"))


@_add("j5_chain_edges", "SELECT run, src, dst FROM {m_edges}")
def _(t):
    return graph.chain(t("m_steps"))


@_add("j6_inputs", "SELECT run, CAST(dst AS INT) AS step, string_agg(v, ',' ORDER BY o) AS inputs FROM (SELECT DISTINCT run, dst, 0 AS o, 'base' AS v FROM {m_diamond_edges} UNION SELECT run, dst, src + 1, 'out' || src FROM {m_diamond_edges} WHERE src <> 2) GROUP BY 1, 2")
def _(t):
    s, e = _diamond(t)
    declared = e.select("run", F.col("dst").alias("step"), F.lit(0).alias("pos"), F.lit("base").alias("data_id")).distinct()
    outputs = s.select("run", "step", F.when(F.col("step") == 2, "base").otherwise(F.concat(F.lit("out"), "step")).alias("output_id"))
    return graph.bind_inputs(declared, e, outputs).select("run", "step", F.array_join("inputs", ",").alias("inputs"))


@_add("j7_outcomes", f"SELECT run, CAST(step AS INT) AS step, CASE WHEN step = 0 AND run % 4 = 3 THEN 'resumed' WHEN run % 4 = 0 AND step = 1 THEN 'failed' WHEN run % 4 = 0 AND step = 3 THEN 'skipped' WHEN run % 4 = 1 AND step = 0 THEN 'failed' WHEN run % 4 = 1 THEN 'skipped' ELSE 'success' END AS status FROM ({_DIAMOND_STEPS})")
def _(t):
    s, e = _diamond(t)
    failing = s.where("(run % 4 = 0 and step = 1) or (run % 4 = 1 and step = 0)")
    return graph.outcomes(s, e, failing, s.where("run % 4 = 3 and step = 0"))


@_add("j8_skipped", "SELECT run, step FROM {m_steps} WHERE step > 1 AND run % 2 = 0")
def _(t):
    s = t("m_steps")
    return graph.skipped(t("m_edges"), s.where("step = 1 and run % 2 = 0"))


@_add("j9_bytes_moved", "SELECT e.run, CAST(sum(octet_length(encode(s.payload))) AS BIGINT) AS moved_bytes FROM {m_edges} e JOIN {m_steps} s ON s.run = e.run AND s.step = e.src WHERE (e.src * 7 + e.run) % 3 <> (e.dst * 7 + e.run) % 3 GROUP BY 1")
def _(t):
    s = t("m_steps")
    return graph.bytes_moved(t("m_edges"), s.select("run", "step", ((F.col("step") * 7 + F.col("run")) % 3).alias("node_id")), s.select("run", "step", F.octet_length("payload").cast("long").alias("size_bytes")))


# -- K: control -----------------------------------------------------------------------------------------------

_SIGNALS = "SELECT task_id, 1 + task_id % 12 AS nodes, (task_id * 7) % 40 AS depth, CAST((task_id * 13) % 100 AS DOUBLE) / 100 AS cpu, CAST((task_id * 3) % 50 AS DOUBLE) AS wait, CASE task_id % 3 WHEN 0 THEN 'queue' WHEN 1 THEN 'cpu' ELSE 'latency' END AS kind, CASE task_id % 3 WHEN 0 THEN 4.0 WHEN 1 THEN 0.7 ELSE 20.0 END AS target FROM {m_tasks}"
_RATIO = f"SELECT *, CASE kind WHEN 'queue' THEN CAST(depth AS DOUBLE) / (4.0::DOUBLE * greatest(nodes, 1)) WHEN 'cpu' THEN cpu / 0.7::DOUBLE ELSE wait / 20.0::DOUBLE END AS ratio FROM ({_SIGNALS})"


def _signals(t) -> DataFrame:
    i = F.col("task_id")
    s = t("m_tasks").select("task_id", (1 + i % 12).alias("nodes"), ((i * 7) % 40).alias("depth"), (((i * 13) % 100).cast("double") / 100).alias("cpu"), ((i * 3) % 50).cast("double").alias("wait"))
    kind = F.when(i % 3 == 0, "queue").when(i % 3 == 1, "cpu").otherwise("latency")
    value = F.when(i % 3 == 0, 4.0).when(i % 3 == 1, 0.7).otherwise(20.0)
    return s.withColumn("ratio", control.ratio(kind, value, F.col("nodes"), F.col("depth"), F.col("cpu"), F.col("wait")))


@_add("k1_ratio", f"SELECT task_id, round(ratio, 6) AS ratio FROM ({_RATIO})")
def _(t):
    return _signals(t).select("task_id", F.round("ratio", 6).alias("ratio"))


@_add("k2_autoscale", f"WITH r AS ({_RATIO}), d AS (SELECT *, CASE WHEN nodes < 2 THEN 'up' WHEN ratio > 1 + 0.1::DOUBLE AND least(greatest(ceil(nodes * ratio), 2), 10) > nodes THEN 'up' WHEN ratio < 1 - 0.1::DOUBLE AND depth = 0 AND least(greatest(floor(nodes * ratio), 1, 2), 10) < nodes THEN 'down' ELSE 'none' END AS action FROM r) SELECT task_id, action, CAST(CASE WHEN nodes < 2 THEN 2 WHEN action = 'up' THEN least(greatest(ceil(nodes * ratio), 2), 10) WHEN action = 'down' THEN least(greatest(floor(nodes * ratio), 1, 2), 10) ELSE nodes END AS BIGINT) AS \"to\" FROM d")
def _(t):
    return control.decide(_signals(t), 2, 10, 0.1).select("task_id", "action", "to")


@_add("k3_autoscale_in_order")
def _(t):
    return control.decide_in_order(_signals(t).withColumn("lane", F.col("task_id") % 16).withColumn("at", F.col("task_id")), "lane", 300, min_nodes=2)


_METRICS = "SELECT * FROM (VALUES ('bytes', 100.0, 101.0, true, 2.0, true), ('skips', 10.0, 7.0, false, 2.0, true), ('wall', 50.0, 90.0, true, 50.0, false), ('new', 0.0, 3.0, true, 2.0, true), ('same', 0.0, 0.0, true, 2.0, true)) AS v(metric, baseline, current, lower_is_better, tolerance, gating)"
_CHANGES = f"SELECT metric, CAST(baseline AS DOUBLE) AS baseline, CAST(current AS DOUBLE) AS current, CAST(CASE WHEN baseline <> 0 THEN round((current - baseline) / baseline * 100, 6) WHEN current = 0 THEN 0 ELSE 100 END AS DOUBLE) AS change, CASE WHEN lower_is_better THEN 1 ELSE -1 END * CASE WHEN baseline <> 0 THEN (current - baseline) / baseline * 100 WHEN current = 0 THEN 0 ELSE 100 END > tolerance AS regressed, gating FROM ({_METRICS})"


def _checks(t) -> DataFrame:
    m = _rows(t, _METRICS)
    m = m.select("metric", *[F.col(c).cast("double").alias(c) for c in ("baseline", "current", "tolerance")], "lower_is_better", "gating")
    return control.regressions(m.withColumnRenamed("baseline", "value"), m.select("metric", F.col("current").alias("value"))).withColumn("change", F.round("change", 6))


@_add("k4_regression", f"SELECT metric, baseline, current, change, regressed, gating FROM ({_CHANGES})")
def _(t):
    return _checks(t).select("metric", "baseline", "current", "change", "regressed", "gating")


@_add("k5_gate", f"SELECT false AS refused, bool_or(gating AND regressed) AS failed, CAST(count(*) FILTER (WHERE NOT gating AND regressed) AS BIGINT) AS warnings FROM ({_CHANGES})")
def _(t):
    return control.gate(_checks(t), F.lit(True))


@_add("k6_http_class", f"SELECT status, class FROM ({_STATUSES})")
def _(t):
    return _rows(t, _STATUSES).select("status", C.http_class(F.col("status")).alias("class"))


_ERRORS = "SELECT * FROM (VALUES ('no eligible node', 503), ('the queue is full', 503), ('task failed: bad input', 422), ('lost connection', 500)) AS v(message, status)"


@_add("k7_error_status", _ERRORS)
def _(t):
    return _rows(t, _ERRORS).select("message", C.error_status(F.col("message")).alias("status"))


# -- L: sets --------------------------------------------------------------------------------------------------

_same("l1_union", "SELECT data_id FROM {m_locations} UNION SELECT data_id FROM {m_task_inputs}")
_same("l2_difference", "SELECT data_id FROM {m_task_inputs} EXCEPT SELECT data_id FROM {m_locations}")
_same("l3_intersection", "SELECT data_id FROM {m_task_inputs} INTERSECT SELECT data_id FROM {m_locations}")
_same("l4_sorted_ids", "SELECT DISTINCT node_id FROM {m_locations} ORDER BY node_id")


# -- M: streams (replayed) ------------------------------------------------------------------------------------


def _stream(name: str, build, mode: str, sql: str | None = None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return monitor.drain(build(monitor.replay(spark, sf_dir, "3650 days"), spark, sf_dir), mode)

    _QUERIES[name] = run
    if sql:
        _SQL[name] = portable(sql)


_stream("m1_stream_state", lambda s, spark, d: monitor.node_state(s).select("node_id", "n", F.round("smooth", 6).alias("smooth")), "update")
_stream("m4_known_senders", lambda s, spark, d: monitor.known_only(s, view(spark, d, "m_nodes")).select("event_id", "node_id"), "append", "SELECT event_id, node_id FROM {m_heartbeats} WHERE node_id IN (SELECT node_id FROM {m_nodes})")
_LATE = "make_dt_interval(0, 0, 0, CAST(event_id % 60 AS DECIMAL(8, 6)))"
_stream("m3_reply_times", lambda s, spark, d: monitor.reply_times(s.withColumnRenamed("event_id", "key"), monitor.replay(spark, d, "3650 days", _LATE).withColumnRenamed("event_id", "key"), "30 SECONDS").select("key", (F.unix_micros("replied") - F.unix_micros("asked")).alias("micros")), "append", "SELECT event_id AS key, event_id % 60 * 1000000 AS micros FROM {m_heartbeats} WHERE event_id % 60 <= 30")


@_add("m3b_expired", "SELECT event_id AS key FROM {m_heartbeats} WHERE event_id % 60 > 30")
def _(t):
    asked = t("m_heartbeats").select(F.col("event_id").alias("key"), "ts")
    return monitor.expired(asked, asked.select("key", (F.col("ts") + F.expr(_LATE.replace("event_id", "key"))).alias("ts")), "30 SECONDS").select("key")


_REPLIES = "SELECT event_id AS seq, CASE WHEN event_id % 31 = 0 THEN NULL ELSE node_id END AS sender, CASE WHEN event_id % 97 = 0 THEN node_id + 1 ELSE node_id END AS claimed, event_id // 2 AS task_id FROM {m_heartbeats}"


@_add(
    "m4b_screened",
    f"""WITH r AS ({_REPLIES}), l AS (SELECT *, min(CASE WHEN claimed <> sender THEN seq END) OVER (PARTITION BY sender) AS lie FROM r),
h AS (SELECT *, sender IS NOT NULL AND (lie IS NULL OR seq < lie) AS heard FROM l),
f AS (SELECT *, min(CASE WHEN heard THEN seq END) OVER (PARTITION BY task_id) AS fst FROM h)
SELECT seq, CASE WHEN sender IS NULL THEN 'unregistered' WHEN seq = lie THEN 'impostor' WHEN NOT heard THEN 'closed' WHEN seq = fst AND task_id IN (SELECT task_id FROM {{m_tasks}}) THEN 'accepted' ELSE 'unknown or expired task' END AS verdict FROM f""",
)
def _(t):
    node, seq = F.col("node_id"), F.col("event_id")
    said = t("m_heartbeats").select(seq.alias("seq"), F.when(seq % 31 != 0, node).alias("sender"), F.when(seq % 97 == 0, node + 1).otherwise(node).alias("claimed"), F.floor(seq / 2).alias("task_id"))
    return monitor.screen(said, t("m_tasks")).select("seq", "verdict")


def _timers(t) -> DataFrame:
    rows = config.parse("probe_interval_secs = 20").timers().items()
    return _rows(t, "SELECT * FROM (VALUES " + ", ".join(f"('{name}', {seconds})" for name, seconds in rows) + ") AS v(name, seconds)")


@_add("m2_ticks", "SELECT name, CAST(unnest(range(0, 3601, seconds)) AS BIGINT) AS at FROM (VALUES ('health', 5), ('probe', 20), ('metrics', 60)) AS v(name, seconds)")
def _(t):
    return monitor.ticks(_timers(t), 3600)


_stream("m5_tumbling", lambda s, spark, d: monitor.tumbling(s).select(F.unix_micros("start").alias("start"), "event_type", "n", "cents"), "complete", "SELECT epoch_us(ts) // 3600000000 * 3600000000 AS start, event_type, CAST(count(*) AS BIGINT) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM {m_heartbeats} GROUP BY 1, 2")
_stream("m5b_sliding", lambda s, spark, d: monitor.sliding(s).select(F.unix_micros("start").alias("start"), "n"), "complete", "SELECT epoch_us(ts) // 1800000000 * 1800000000 - k * 1800000000 AS start, CAST(count(*) AS BIGINT) AS n FROM {m_heartbeats} CROSS JOIN (SELECT unnest([0, 1]) AS k) GROUP BY 1")
_stream("m5c_sessions", lambda s, spark, d: monitor.sessions(s, "1 hour").select("node_id", F.unix_micros("start").alias("start"), "n"), "complete", "WITH a AS (SELECT node_id, epoch_us(ts) AS u, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY node_id ORDER BY ts) < 3600000000 THEN 0 ELSE 1 END AS b FROM {m_heartbeats}), s AS (SELECT *, sum(b) OVER (PARTITION BY node_id ORDER BY u ROWS UNBOUNDED PRECEDING) AS g FROM a) SELECT node_id, min(u) AS start, CAST(count(*) AS BIGINT) AS n FROM s GROUP BY node_id, g")


# -- N: task kinds --------------------------------------------------------------------------------------------


_STEPS = " + ".join(f"CAST(ord(payload[{i + 1}]) AS HUGEINT) * {256**i}" for i in range(8))
_KINDS = f"""
WITH i AS (SELECT ti.task_id, ti.data_id, h.data_id IS NOT NULL AS there FROM {{m_task_inputs}} ti LEFT JOIN (SELECT DISTINCT data_id FROM {{m_locations}}) h ON h.data_id = ti.data_id),
p AS (SELECT task_id, string_agg(sha256(CAST(data_id AS VARCHAR)), '' ORDER BY data_id) AS data, min(data_id) FILTER (WHERE NOT there) AS lost FROM i GROUP BY 1)
SELECT t.task_id, CASE WHEN kind = 'echo' THEN payload WHEN kind = 'hash' AND lost IS NULL THEN sha256(payload || coalesce(data, '')) END AS output,
  CASE WHEN kind = 'hash' THEN 'missing input: ' || lost
    WHEN kind = 'cpu' AND octet_length(encode(payload)) <> 8 THEN 'a count of steps has 8 bytes, not ' || octet_length(encode(payload))
    WHEN kind = 'cpu' THEN ({_STEPS}) || ' steps are over the limit of 50000000'
    WHEN kind NOT IN ('echo', 'hash') THEN 'unknown task kind: ' || kind END AS error
FROM {{m_tasks}} t LEFT JOIN p ON p.task_id = t.task_id"""


@_add("n1_run_kinds", _KINDS)
def _(t):
    held = t("m_locations").select("data_id").distinct().withColumn("data", F.sha2(F.col("data_id").cast("string").cast("binary"), 256).cast("binary"))
    read = t("m_task_inputs").join(held, "data_id", "left").select("task_id", F.col("data_id").alias("pos"), "data_id", "data")
    return kinds.run_kinds(t("m_tasks"), read).select("task_id", F.col("output").cast("string").alias("output"), "error")


@_add("n3_user_module", "SELECT task_id, upper(payload) AS output FROM {m_tasks}")
def _(t):
    up = kinds.module(lambda payload, inputs: payload.upper())
    return t("m_tasks").select("task_id", up(F.col("payload").cast("binary"), F.array().cast("array<binary>")).alias("r")).select("task_id", F.col("r.output").cast("string").alias("output"))


_READS = """
WITH i AS (SELECT task_id, list(sha256(CAST(data_id AS VARCHAR)) ORDER BY data_id) AS xs FROM {m_task_inputs} GROUP BY 1),
a AS (SELECT t.task_id, CASE WHEN client % 4 >= 1 THEN xs[client % 4] END AS x, priority * 16 - 8 AS len, t.task_id % 3 * 40 AS ptr FROM {m_tasks} t LEFT JOIN i ON i.task_id = t.task_id)
SELECT task_id, CAST(CASE WHEN ok THEN least(len, 32) ELSE -1 END AS BIGINT) AS n, CASE WHEN ok THEN substr(x, 1, 2 * least(len, 32)) END AS data
FROM (SELECT *, x IS NOT NULL AND len >= 0 AND ptr + least(len, 32) <= 100 AS ok FROM a) q"""


@_add("n6_read_input", _READS)
def _(t):
    xs = t("m_task_inputs").groupBy("task_id").agg(F.array_sort(F.collect_list("data_id")).alias("ids"))
    inputs = F.transform("ids", lambda i: F.unhex(F.sha2(i.cast("string").cast("binary"), 256)))
    got = kinds.read_input(inputs, (F.col("client") % 4 - 1).cast("int"), F.col("priority") * 16 - 8, F.lit(100), F.col("task_id") % 3 * 40)
    return t("m_tasks").join(xs, "task_id", "left").select("task_id", got.alias("r")).select("task_id", "r.n", F.lower(F.hex("r.data")).alias("data"))


_ANSWERS = "SELECT task_id, CAST(task_id % 5 AS BIGINT) * 40 AS ptr, CAST(priority * 30 AS BIGINT) AS len FROM {m_tasks}"


@_add("n7_check_output", f"SELECT task_id, ptr, len, CASE WHEN len > 100 THEN 'output of ' || len || ' bytes, at most 100' WHEN ptr + len > 180 THEN 'output outside memory: ' || len || ' bytes at ' || ptr END AS error FROM ({_ANSWERS})")
def _(t):
    packed = F.shiftleft((F.col("task_id") % 5 * 40).cast("long"), 32) + F.col("priority") * 30
    return t("m_tasks").select("task_id", kinds.check_output(packed, F.lit(180), 100).alias("r")).select("task_id", "r.*")


@_add("n8_ascii_upper", "SELECT blob_id, translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') AS text FROM {m_blobs}")
def _(t):
    return t("m_blobs").select("blob_id", C.ascii_upper(F.col("text")).alias("text"))


del names
