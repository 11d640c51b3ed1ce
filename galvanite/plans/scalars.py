"""Queries of the column functions, on stand-ins among the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galvanite.functions import naming
from galvanite.plans.registry import query, table

_CHECKSUM = "CASE p_size % 7 WHEN 0 THEN concat(' MD5:', upper(p_brand)) WHEN 1 THEN concat('sha256: ', p_name) WHEN 2 THEN concat('sha1:', p_name) WHEN 3 THEN p_name WHEN 4 THEN concat(':', p_name) WHEN 5 THEN 'md5: ' ELSE 'md5:' END"


@query(rf"""WITH c AS (SELECT p_partkey, {_CHECKSUM} AS t FROM part),
d AS (SELECT p_partkey, lower(trim(split_part(t, ':', 1))) AS a, lower(trim(substr(t, instr(t, ':') + 1))) AS h, instr(t, ':') > 0 AND substr(t, instr(t, ':') + 1) <> '' AS named FROM c),
e AS (SELECT *, CASE WHEN NOT named THEN 'no_algorithm' WHEN a NOT IN ('md5', 'sha256') THEN 'unsupported_algorithm' END AS problem FROM d)
SELECT p_partkey, CASE WHEN problem IS NULL THEN a END AS algorithm, CASE WHEN problem IS NULL THEN h END AS digest, problem FROM e""")
def checksum_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", naming.checksum_parts(F.expr(_CHECKSUM)).alias("c")).select("p_partkey", "c.*")


_FILE = "CASE p_size % 6 WHEN 0 THEN '..' WHEN 1 THEN concat('a/', p_name) WHEN 2 THEN concat('C:', p_name) WHEN 3 THEN '' ELSE concat(p_name, '.zip') END"


@query(rf"SELECT p_partkey, CASE WHEN f IN ('', '.', '..') THEN 'unusable' WHEN f LIKE '%/%' OR contains(f, '\') THEN 'separator' WHEN substr(f, 2, 1) = ':' THEN 'drive' END AS problem FROM (SELECT p_partkey, {_FILE} AS f FROM part)")
def unsafe_filenames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", naming.unsafe_filename(F.expr(_FILE)).alias("problem"))


_MEMBER = "CASE p_size % 6 WHEN 0 THEN concat(p_brand, '_XPS_predicted.csv') WHEN 1 THEN concat(p_brand, '_XPS.csv') WHEN 2 THEN concat(p_brand, '_EDX.csv') WHEN 3 THEN concat(p_brand, '_LSV.csv') WHEN 4 THEN 'SECCM_dataset/LSV_fit_parameters.csv' ELSE concat(p_brand, '.txt') END"


@query(rf"""SELECT p_partkey, kind, coalesce(kind LIKE 'measured%', false) AS measured FROM (SELECT p_partkey, CASE WHEN m = 'SECCM_dataset/LSV_fit_parameters.csv' THEN 'source_fitted_parameters' WHEN m LIKE '%\_XPS\_predicted.csv' ESCAPE '\' THEN 'predicted_xps'
WHEN m LIKE '%\_XPS.csv' ESCAPE '\' THEN 'measured_xps' WHEN m LIKE '%\_EDX.csv' ESCAPE '\' THEN 'measured_edx' WHEN m LIKE '%\_LSV.csv' ESCAPE '\' THEN 'measured_lsv' END AS kind FROM (SELECT p_partkey, {_MEMBER} AS m FROM part))""")
def member_source_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = table(spark, sf_dir, "part").select("p_partkey", naming.source_type(F.expr(_MEMBER)).alias("kind"))
    return kinds.withColumn("measured", F.coalesce(naming.measured(F.col("kind")), F.lit(False)))


_ORIGIN = "CASE WHEN event_id % 2 = 0 THEN 'observed' ELSE 'synthetic' END"
_MODE = "CASE user_id % 3 WHEN 0 THEN 'replay' WHEN 1 THEN 'simulation' ELSE 'live' END"


@query(f"""WITH e AS (SELECT event_id, {_ORIGIN} AS o, {_MODE} AS m FROM events)
SELECT event_id, (o = 'observed' AND m <> 'simulation') OR (o = 'synthetic' AND m <> 'live') AS admissible, CASE WHEN NOT (o = 'observed' AND m = 'replay') THEN 'declared ' || o || '+' || m || ', read observed+replay' END AS mismatch FROM e""")
def origin_and_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    origin, mode = F.expr(_ORIGIN), F.expr(_MODE)
    return table(spark, sf_dir, "events").select("event_id", naming.admissible(origin, mode).alias("admissible"), naming.environment_mismatch(origin, mode, F.lit("observed"), F.lit("replay")).alias("mismatch"))


_RAW_KEY = "CASE event_id % 4 WHEN 0 THEN concat('  ', event_type, ' ') WHEN 1 THEN '   ' WHEN 2 THEN repeat(event_type, 60) ELSE props END"


@query(rf"""WITH e AS (SELECT event_id, user_id, event_type, trim({_RAW_KEY}) AS k FROM events)
SELECT event_id, 'execute_work_item:' || user_id || ':2' AS instruction_key, CASE WHEN k <> '' AND length(k) <= 255 THEN k END AS client_key, CASE WHEN k = '' THEN 'missing_key' WHEN length(k) > 255 THEN 'oversized_key' END AS problem,
 sha256('{{"event_type":"' || event_type || '","user_id":' || user_id || '}}') AS fingerprint FROM e""")
def command_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = naming.client_key(F.expr(_RAW_KEY))
    return table(spark, sf_dir, "events").select("event_id", naming.instruction_key(F.col("user_id"), F.lit(2)).alias("instruction_key"), key["key"].alias("client_key"), key["problem"].alias("problem"), naming.fingerprint(user_id=F.col("user_id"), event_type=F.col("event_type")).alias("fingerprint"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(CASE l_returnflag WHEN 'A' THEN CAST(l_quantity AS DECIMAL(18,2)) * 0.001 WHEN 'N' THEN CAST(l_quantity AS DECIMAL(18,2)) END AS DOUBLE) AS seconds,
 CAST(l_extendedprice AS DECIMAL(18,2)) AS reserved, CAST(CASE WHEN l_linestatus = 'F' THEN l_discount ELSE l_extendedprice END AS DECIMAL(18,2)) AS incurred FROM lineitem""")
def intervals_and_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    money = lambda c: F.col(c).cast("decimal(18,2)")
    unit = F.when(F.col("l_returnflag") == "A", "ms").when(F.col("l_returnflag") == "N", "s").otherwise("h")
    cost = naming.budget_cost(money("l_extendedprice"), F.lit("h"), F.when(F.col("l_linestatus") == "F", money("l_discount")))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", naming.interval_in_seconds(money("l_quantity"), unit).cast("double").alias("seconds"), cost["reserved"].alias("reserved"), cost["incurred"].alias("incurred"))


@query("SELECT event_id, ts + to_seconds(CAST(30 * (event_id % 5) AS BIGINT)) AS expires_at FROM events")
def lease_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", naming.lease_expiry(F.col("ts"), 30 * (F.col("event_id") % 5)).alias("expires_at"))


@query("""SELECT doc_id, CASE WHEN lang = 'en' AND source = 'web' THEN 'permitted_with_attribution' ELSE 'unresolved' END AS redistribution FROM documents""")
def redistribution_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = naming.redistribution(F.lit("unresolved"), F.col("lang"), F.col("source"), decided_licence="en", decided_doi="web", decision="permitted_with_attribution")
    return table(spark, sf_dir, "documents").select("doc_id", found.alias("redistribution"))


@query("""SELECT page_id, sha256(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;')) AS escaped_sha256 FROM pages""")
def escaped_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(naming.escaped(F.col("html")), 256).alias("escaped_sha256"))
