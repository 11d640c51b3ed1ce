"""Queries of assertions, validation, mappings, listings and order checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galvanite.operators import assertions, evidence, experiments, mapping, profile, series
from galvanite.plans.registry import query, table
from galvanite.sources import listings

_TECHNIQUE = "CASE WHEN o_orderstatus = 'F' THEN 'galvanostatic_electrolysis' ELSE 'cyclic_voltammetry' END"
_FIELDS = [(t, f, c, None) for t, fs in assertions.METADATA.items() for f, c in fs.items()] + [(t, f, "optional", "not_applicable") for t, fs in assertions.NOT_APPLICABLE.items() for f in fs]
_FIELD_ROWS = ", ".join(f"('{t}', '{f}', '{c}', {repr(s) if s else 'NULL'})" for t, f, c, s in _FIELDS)


@query(f"""WITH o AS (SELECT 'o' || o_orderkey AS observation_id, 's' || o_custkey AS source_artifact_id, {_TECHNIQUE} AS technique FROM orders),
s AS (SELECT 'o' || l_orderkey AS observation_id, CASE l_linenumber WHEN 1 THEN 'potential' WHEN 2 THEN 'current' WHEN 3 THEN 'time' ELSE 'current_density' END AS role, 'c' || l_partkey AS source_column, l_returnflag AS source_unit, 'A' AS unit, {_TECHNIQUE} AS technique FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_linenumber < 5),
q(technique, field_name, class, st) AS (VALUES {_FIELD_ROWS}),
m AS (SELECT 'o' || l_orderkey AS observation_id, CASE l_linenumber WHEN 5 THEN 'current_basis' WHEN 6 THEN 'reference_scale' ELSE 'scan_rate' END AS field_name, CASE WHEN min(l_returnflag) = 'N' THEN 'unavailable' ELSE 'known' END AS state, CAST(min(l_suppkey) AS VARCHAR) AS value FROM lineitem WHERE l_linenumber >= 5 GROUP BY l_orderkey, l_linenumber),
r AS (SELECT observation_id, 'source_artifact' AS field_name, 'required' AS requirement_class, 'source_file' AS origin, 'none' AS transformation, 'known' AS state, source_artifact_id AS value, NULL AS unit FROM o
UNION ALL SELECT observation_id, 'observation', 'required', 'source_file', 'derived', 'known', observation_id, NULL FROM o
UNION ALL SELECT observation_id, 'parser_record', 'required', 'source_file', 'parsed', 'known', 'p' || substr(observation_id, 2), NULL FROM o WHERE CAST(substr(observation_id, 2) AS BIGINT) % 3 = 0
UNION ALL SELECT observation_id, CASE WHEN role LIKE 'current%' THEN 'current_axis' ELSE role || '_axis' END, 'required', 'user_supplied', CASE WHEN source_unit = unit THEN 'parsed' ELSE 'unit_converted' END, 'known', source_column, unit FROM s WHERE role <> 'time' OR technique LIKE 'galv%'
UNION ALL SELECT observation_id, 'current_quantity_kind', 'required', 'user_supplied', 'none', 'known', role, NULL FROM s WHERE role LIKE 'current%' AND technique LIKE 'galv%'
UNION ALL SELECT o.observation_id, q.field_name, q.class, 'user_supplied', 'none', coalesce(q.st, m.state, 'unknown'), CASE WHEN q.st IS NULL THEN m.value END, NULL FROM o JOIN q ON q.technique = o.technique LEFT JOIN m ON m.observation_id = o.observation_id AND m.field_name = q.field_name)
SELECT 'experiment:' || substr(sha256('{{"observation_id":"' || observation_id || '"}}'), 1, 32) AS experiment_id, observation_id, field_name, requirement_class, origin, transformation, state, value, CAST(unit AS VARCHAR) AS unit FROM r""")
def initial_assertions(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    name = lambda p, c: F.concat(F.lit(p), F.col(c))
    at = F.col("l_linenumber")
    role = F.when(at == 1, "potential").when(at == 2, "current").when(at == 3, "time").otherwise("current_density")
    observations = orders.select(name("o", "o_orderkey").alias("observation_id"), name("s", "o_custkey").alias("source_artifact_id"), F.expr(_TECHNIQUE).alias("technique"), F.when(F.col("o_orderkey") % 3 == 0, name("p", "o_orderkey")).alias("parser_record_id"))
    kinds = lines.where("l_linenumber < 5").select(name("o", "l_orderkey").alias("observation_id"), role.alias("role"), name("c", "l_partkey").alias("source_column"), F.col("l_returnflag").alias("source_unit"), F.lit("A").alias("unit"))
    field = F.when(at == 5, "current_basis").when(at == 6, "reference_scale").otherwise("scan_rate")
    declared = lines.where("l_linenumber >= 5").groupBy(name("o", "l_orderkey").alias("observation_id"), field.alias("field_name")).agg(F.when(F.min("l_returnflag") == "N", "unavailable").otherwise("known").alias("state"), F.min("l_suppkey").cast("string").alias("value"), F.lit(None).cast("string").alias("unit"))
    return assertions.initial_assertions(observations, kinds, declared)


_EDIT = """SELECT event_id AS edit_id, user_id AS experiment_id, CASE event_id % 3 WHEN 0 THEN 'galvanostatic_electrolysis' ELSE 'cyclic_voltammetry' END AS technique, 1 AS version, CASE WHEN event_id % 10 = 0 THEN 2 ELSE 1 END AS expected_version,
 CASE event_id % 4 WHEN 0 THEN 'auxiliary_result.x' WHEN 1 THEN 'scan_rate' WHEN 2 THEN 'note' ELSE 'operator' END AS field_name, CASE WHEN event_id % 13 = 0 THEN 'inferred' ELSE 'user_supplied' END AS origin,
 CASE WHEN event_type = 'view' THEN 'a' || event_id % 4 END AS supplements, CASE WHEN event_type = 'click' THEN 'a' || event_id % 5 END AS supersedes FROM {events}"""
_HELD = """SELECT DISTINCT user_id AS experiment_id, 'a' || event_id % 4 AS assertion_id, CASE event_id % 4 WHEN 0 THEN 'operator' WHEN 1 THEN 'scan_rate' WHEN 2 THEN 'note' ELSE 'operator' END AS field_name, CASE event_id % 4 WHEN 0 THEN 'source_file' WHEN 3 THEN 'inferred' ELSE 'user_supplied' END AS origin, event_id % 4 <> 2 AS active FROM {events}"""
_OWNED = ", ".join(f"'{f}'" for f in assertions.PROFILE_FIELDS)


@query(f"""WITH e AS ({_EDIT.format(events="events")}), h AS ({_HELD.format(events="events")}) SELECT edit_id, CASE WHEN expected_version <> version THEN 'version_conflict' WHEN e.origin <> 'user_supplied' THEN 'origin_not_user' WHEN technique LIKE 'galv%' AND e.field_name LIKE 'auxiliary%' THEN 'auxiliary_results_come_from_records'
 WHEN technique LIKE 'galv%' AND e.field_name IN ({_OWNED}) THEN 'profile_owns_field' WHEN supplements IS NOT NULL AND coalesce(p.field_name <> e.field_name, true) THEN 'supplements_other_field' WHEN supersedes IS NOT NULL AND NOT coalesce(s.active, false) THEN 'supersedes_inactive'
 WHEN s.origin = 'source_file' THEN 'source_assertions_are_fixed' WHEN supersedes IS NOT NULL AND (s.origin <> 'user_supplied' OR s.field_name <> e.field_name) THEN 'supersedes_other_assertion' END AS problem
FROM e LEFT JOIN h p ON p.experiment_id = e.experiment_id AND p.assertion_id = supplements LEFT JOIN h s ON s.experiment_id = e.experiment_id AND s.assertion_id = supersedes""")
def edit_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return assertions.edit_problems(spark.sql(_EDIT, events=events), spark.sql(_HELD, events=events)).select("edit_id", "problem")


_ACTIVE = """SELECT user_id AS experiment_id, CASE event_id % 8 WHEN 0 THEN 'source_artifact' WHEN 1 THEN 'observation' WHEN 2 THEN 'current_basis' WHEN 3 THEN 'electrode_area' WHEN 4 THEN 'current_quantity_kind' WHEN 5 THEN 'auxiliary_result.x' WHEN 6 THEN 'mystery' ELSE 'scan_rate' END AS field_name, event_id,
 CASE event_type WHEN 'error' THEN 'unknown' WHEN 'signup' THEN CASE event_id % 8 WHEN 3 THEN 'not_applicable' ELSE 'unavailable' END ELSE 'known' END AS state, CASE event_id % 8 WHEN 2 THEN CASE WHEN event_type = 'view' THEN 'total_current' ELSE 'geometric_area' END WHEN 4 THEN CASE WHEN event_type = 'click' THEN 'current' ELSE 'current_density' END ELSE 'v' END AS value FROM {events}"""
_REQ = ", ".join(f"('{t}', '{f}')" for t, fs in experiments.REQUIRED.items() for f in fs)


@query(f"""WITH a0 AS ({_ACTIVE.format(events="events")}), a AS (SELECT experiment_id, field_name, arg_max(state, event_id) AS state, arg_max(value, event_id) AS value FROM a0 GROUP BY ALL), x AS (SELECT DISTINCT user_id AS experiment_id, CASE WHEN user_id % 2 = 0 THEN 'galvanostatic_electrolysis' ELSE 'cyclic_voltammetry' END AS technique FROM events),
q(technique, field_name) AS (VALUES {_REQ}), w AS (SELECT experiment_id, q.field_name FROM x JOIN q USING (technique)),
e AS (SELECT coalesce(a.experiment_id, w.experiment_id) AS experiment_id, coalesce(a.field_name, w.field_name) AS field_name, w.field_name IS NOT NULL AS req, a.state FROM w FULL JOIN a ON a.experiment_id = w.experiment_id AND a.field_name = w.field_name),
f AS (SELECT e.experiment_id, e.field_name, CASE WHEN technique LIKE 'galv%' AND e.field_name = 'mystery' AND state = 'known' THEN 'blocking' WHEN req AND (state IS NULL OR state <> 'known') THEN 'blocking' WHEN state IN ('known', 'not_applicable') THEN NULL WHEN state = 'unknown' THEN 'unknown' ELSE 'warning' END AS severity FROM e JOIN x USING (experiment_id)),
c AS (SELECT x.experiment_id, max(CASE WHEN field_name = 'current_quantity_kind' THEN value END) AS kind, max(CASE WHEN field_name = 'current_basis' THEN state END) AS bs, max(CASE WHEN field_name = 'current_basis' THEN value END) AS b, max(CASE WHEN field_name = 'electrode_area' THEN state END) AS ar FROM x LEFT JOIN a ON a.experiment_id = x.experiment_id WHERE technique LIKE 'galv%' GROUP BY 1),
m AS (SELECT experiment_id FROM c WHERE NOT coalesce((kind = 'current_density' AND bs = 'known' AND b = 'geometric_area' AND ar = 'known') OR (kind = 'current' AND bs = 'known' AND b = 'total_current' AND ar = 'not_applicable'), false))
SELECT * FROM f WHERE severity IS NOT NULL AND NOT (field_name = 'current_basis' AND experiment_id IN (SELECT experiment_id FROM m)) UNION ALL SELECT experiment_id, 'current_basis', 'blocking' FROM m""")
def technique_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    active = experiments.resolve_fields(spark.sql(_ACTIVE, events=events), ["experiment_id", "field_name"], F.lit(0), "event_id").withColumn("requirement_class", F.lit("recommended"))
    known = events.select(F.col("user_id").alias("experiment_id")).distinct().withColumn("technique", F.when(F.col("experiment_id") % 2 == 0, "galvanostatic_electrolysis").otherwise("cyclic_voltammetry"))
    return assertions.validated(active, known)


_REQUEST = "SELECT o_orderkey AS experiment_id, 2 AS version, CASE WHEN o_custkey % 9 = 0 THEN 1 ELSE 2 END AS validated_version, CASE WHEN o_orderstatus = 'F' THEN 'blocked' ELSE 'eligible' END AS decision, o_custkey % 2 = 0 AS release, CASE WHEN o_custkey % 2 = 0 OR o_custkey % 5 = 0 THEN o_orderdate END AS released_at FROM {orders}"


@query(f"""WITH d AS ({_REQUEST.format(orders="orders")}), p AS (SELECT *, CASE WHEN validated_version <> version THEN 'other_version_validated' WHEN release AND decision = 'blocked' THEN 'blocked' WHEN release <> (released_at IS NOT NULL) THEN 'release_time_mismatch' END AS problem, CASE WHEN release THEN 'released' ELSE 'preview' END AS st FROM d)
SELECT experiment_id, CASE WHEN problem IS NULL THEN 'passport:' || substr(sha256('{{"decision":"' || decision || '","experiment_id":' || experiment_id || ',"release_status":"' || st || '","version":2}}'), 1, 32) END AS passport_id, CASE WHEN problem IS NULL THEN st END AS release_status, problem FROM p""")
def passports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assertions.passports(spark.sql(_REQUEST, orders=table(spark, sf_dir, "orders")))


@query("SELECT l_orderkey, l_partkey, min(l_linenumber) AS created_version, max(l_linenumber) AS last_version FROM lineitem GROUP BY ALL")
def first_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assertions.first_versions(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber", "l_partkey")


@query("SELECT o_custkey, max(o_orderkey) AS o_orderkey, arg_max(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders GROUP BY 1")
def latest_passports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assertions.latest(table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", "o_orderstatus")


@query("""WITH v AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_returnflag = 'N' THEN CASE WHEN l_linenumber = 1 THEN NULL ELSE l_linenumber - 1 END ELSE l_linenumber END AS supersedes FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM v WHERE NOT ((l_linenumber = 1 AND supersedes IS NULL) OR coalesce(supersedes = l_linenumber - 1, false))""")
def broken_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("l_linenumber")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.when(F.col("l_returnflag") == "N", F.when(at != 1, at - 1)).otherwise(at).alias("supersedes"))
    return experiments.broken_versions(rows, "l_orderkey", "l_linenumber", "supersedes").drop("supersedes")


@query("""WITH s AS (SELECT event_id, user_id, CAST(value AS DECIMAL(18,2)) - lag(CAST(value AS DECIMAL(18,2))) OVER (PARTITION BY user_id ORDER BY event_id) AS step FROM events) SELECT event_id, user_id, CAST(step AS DOUBLE) AS step FROM s WHERE step <> 1.00""")
def off_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", F.col("value").cast("decimal(18,2)").alias("value"))
    return series.off_interval(rows, ["user_id"], ["event_id"], "value", F.lit("1.00").cast("decimal(18,2)")).select("event_id", "user_id", F.col("step").cast("double").alias("step"))


@query("SELECT event_id, '/k' AS path FROM events")
def exported_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping.exported_paths(table(spark, sf_dir, "events"), "event_id", "props")


_ENTRIES = "SELECT o_custkey AS k, concat('f', o_orderpriority) AS field, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE concat('/', o_orderstatus) END AS external FROM {orders}"


@query(f"""WITH e AS ({_ENTRIES.format(orders="orders")}), r AS (SELECT c_custkey AS k, 'f1-URGENT' AS field FROM customer)
SELECT k, 'duplicate' AS problem, field AS path FROM e GROUP BY ALL HAVING count(*) > 1 UNION ALL SELECT k, 'collision', external FROM e WHERE external IS NOT NULL GROUP BY ALL HAVING count(*) > 1 UNION ALL SELECT k, 'incomplete', field FROM (SELECT k, field FROM r EXCEPT SELECT k, field FROM e)""")
def mapping_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    required = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.lit("f1-URGENT").alias("field"))
    return mapping.mapping_problems(spark.sql(_ENTRIES, orders=table(spark, sf_dir, "orders")), required, "k")


@query(f"""WITH e AS ({_ENTRIES.format(orders="orders")}), p AS (SELECT c_custkey AS k, '/' || s AS path FROM customer, (VALUES ('O'), ('P'), ('F')) AS t(s)) SELECT k, path FROM p EXCEPT SELECT k, external FROM e""")
def untraced_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.explode(F.array(*map(F.lit, ("/O", "/P", "/F")))).alias("path"))
    return mapping.untraced(paths, spark.sql(_ENTRIES, orders=table(spark, sf_dir, "orders")), "k")


@query("""WITH e AS (SELECT 'o' || o_orderkey AS subject, 'derived_from' AS predicate, 'c' || o_custkey AS object FROM orders), h AS (SELECT 'o' || o_orderkey AS subject, 'derived_from' AS predicate, 'c' || o_custkey AS object FROM orders WHERE o_orderstatus = 'F') SELECT DISTINCT * FROM e EXCEPT SELECT * FROM h""")
def missing_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    edge = lambda rows: rows.select(F.concat(F.lit("o"), "o_orderkey").alias("subject"), F.lit("derived_from").alias("predicate"), F.concat(F.lit("c"), "o_custkey").alias("object"))
    orders = table(spark, sf_dir, "orders")
    return evidence.missing_edges(edge(orders), edge(orders.where("o_orderstatus = 'F'")))


@query("""WITH r AS (SELECT l_orderkey % 50 AS a, l_linenumber AS b, CASE WHEN l_returnflag = 'N' THEN 2 ELSE 3 END AS n FROM lineitem), g AS (SELECT a, b, n, count(*) AS c FROM r GROUP BY ALL)
SELECT CAST(sum(c) AS BIGINT) AS row_count, CAST(sum(c - 1) AS BIGINT) AS duplicate_row_count, CAST(coalesce(sum(c) FILTER (n <> 3), 0) AS BIGINT) AS ragged_row_count FROM g""")
def ragged_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    cell = lambda c: c.cast("string")
    a, b = cell(F.col("l_orderkey") % 50), cell(F.col("l_linenumber"))
    rows = table(spark, sf_dir, "lineitem").select(F.when(F.col("l_returnflag") == "N", F.array(a, b)).otherwise(F.array(a, b, F.lit(""))).alias("cells"))
    return profile.ragged(rows, "cells", 3)


_PATHS = "CASE p_size % 5 WHEN 0 THEN concat('__MACOSX/', p_name) WHEN 1 THEN concat('a/__MACOSX/', p_name, '.csv') WHEN 2 THEN concat(p_name, '.CSV') WHEN 3 THEN concat(p_name, '.png') ELSE concat(p_name, '.dat') END"


@query(f"""WITH m AS (SELECT {_PATHS} AS path FROM part), r AS (SELECT path, CASE WHEN path LIKE '%\\_\\_MACOSX/%' ESCAPE '\\' THEN 'resource_fork' WHEN NOT regexp_matches(lower(path), '[^/]\\.(csv|txt|dat|tsv)$') THEN 'not_delimited_text' END AS reason FROM m) SELECT * FROM r WHERE reason IS NOT NULL""")
def skipped_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listings.skipped(table(spark, sf_dir, "part").select(F.expr(_PATHS).alias("path")), "path")


@query("""WITH m AS (SELECT o_custkey, CASE WHEN o_totalprice > 250000 THEN 'fixture_manifest.json' WHEN o_totalprice < 60000 THEN 'provenance.json' ELSE 'data.csv' END AS name FROM orders), g AS (SELECT o_custkey, bool_or(name = 'fixture_manifest.json') AS f, bool_or(name = 'provenance.json') AS p FROM m GROUP BY 1)
SELECT o_custkey, CASE WHEN f <> p THEN CASE WHEN f THEN 'synthetic' ELSE 'observed' END END AS data_origin, CASE WHEN f AND p THEN 'ambiguous_root' WHEN NOT f AND NOT p THEN 'unknown_root' END AS problem FROM g""")
def resolved_origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("o_totalprice")
    name = F.when(price > 250000, "fixture_manifest.json").when(price < 60000, "provenance.json").otherwise("data.csv")
    return listings.origins(table(spark, sf_dir, "orders").select("o_custkey", name.alias("name")), "o_custkey", "name")


@query("""WITH f AS (SELECT p_name AS filename, max(p_size) AS s FROM part GROUP BY 1), w AS (SELECT row_number() OVER (ORDER BY r_regionkey) - 1 AS position, r_name AS filename FROM region)
SELECT CAST(position AS INTEGER) AS position, w.filename, s AS byte_size, CASE WHEN s IS NULL THEN 'not_listed' WHEN s > 25 THEN 'too_large' END AS problem FROM w LEFT JOIN f ON f.filename = w.filename""")
def selected_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [r["r_name"] for r in table(spark, sf_dir, "region").orderBy("r_regionkey").collect()]  # five rows: the request
    files = table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("filename")).agg(F.max("p_size").alias("byte_size"))
    return listings.selected(files, names, 25)


@query("""SELECT p_partkey, 'd' || p_size AS doi, CAST(p_size AS VARCHAR) AS record_version, CASE WHEN p_size % 4 = 0 THEN '..' ELSE p_name || '.zip' END AS filename, CAST(p_partkey AS BIGINT) AS byte_size, CASE WHEN p_size % 4 <> 1 THEN 'md5' END AS algorithm, CASE WHEN p_size % 4 <> 1 THEN lower(p_brand) END AS digest, CASE p_size % 4 WHEN 0 THEN 'unusable' WHEN 1 THEN 'unsupported_algorithm' END AS problem FROM part""")
def record_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_size") % 4
    file = F.struct(F.when(k == 0, "..").otherwise(F.concat("p_name", F.lit(".zip"))).alias("key"), F.col("p_partkey").alias("size"), F.concat(F.when(k == 1, "sha1:").otherwise("MD5:"), "p_brand").alias("checksum"), F.struct(F.lit("u").alias("self")).alias("links"))
    body = F.struct(F.concat(F.lit("d"), "p_size").alias("doi"), F.lit("1").alias("id"), F.struct(F.lit("t").alias("title"), F.struct(F.array(F.struct(F.col("p_size").alias("index"))).alias("version")).alias("relations")).alias("metadata"), F.array(file).alias("files"))
    return listings.record_files(table(spark, sf_dir, "part").select("p_partkey", F.to_json(body).alias("t")), "p_partkey", "t")
