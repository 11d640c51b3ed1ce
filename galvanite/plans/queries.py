"""Queries of the evidence operators over the driver's tables.

The tables hold no electrochemistry, so each operator runs on a stand-in with
the same shape; each has DuckDB SQL of its own for comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galvanite.functions import canonical, lifecycle, units
from galvanite.operators import budget, constraints, evidence, experiments, jobs, metrics, profile, streams
from galvanite.operators import campaigns as views_of
from galvanite.plans.registry import QUERIES, SQL, query, table

__all__ = ["QUERIES", "SQL"]

def _sweeps(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.col("value").cast("decimal(18,6)")
    return table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("row_no"), (-value + 40).alias("current"), (value / 100).cast("decimal(18,6)").alias("potential"))


_SWEEP_SQL = """
WITH p AS (SELECT user_id, event_id AS row_no, CAST(40 - CAST(value AS DECIMAL(18,6)) AS DECIMAL(18,6)) AS i, CAST(round(CAST(value AS DECIMAL(18,6)) / 100, 6) AS DECIMAL(18,6)) AS e FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY i, row_no) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM p WHERE i IS NOT NULL),
m AS (SELECT user_id, n AS n_samples, CASE WHEN n < 50 THEN 'rejected' WHEN i >= 0 THEN 'warning' ELSE 'accepted' END AS quality_status,
  CASE WHEN n >= 50 THEN i END AS extremum_current, CASE WHEN n >= 50 THEN e END AS extremum_potential FROM r WHERE k = 1)
"""


@query(_SWEEP_SQL + "SELECT user_id, n_samples, quality_status, CAST(extremum_current AS DOUBLE) AS extremum_current, CAST(extremum_potential AS DOUBLE) AS extremum_potential FROM m")
def lsv_extremum(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.cathodic_extremum(_sweeps(spark, sf_dir), "user_id")
    return out.withColumns({c: F.col(c).cast("double") for c in ("extremum_current", "extremum_potential")})


@query(_SWEEP_SQL + """SELECT user_id, quality_status, 'cathodic_extremum_current' AS name, CAST(extremum_current AS DOUBLE) AS value, 'A' AS unit FROM m
UNION ALL SELECT user_id, quality_status, 'cathodic_extremum_potential', CAST(extremum_potential AS DOUBLE), 'V' FROM m""")
def metric_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.metric_rows(metrics.cathodic_extremum(_sweeps(spark, sf_dir), "user_id"), "user_id").withColumn("value", F.col("value").cast("double"))


_KIND = "CASE event_type WHEN 'view' THEN 'reserved' WHEN 'purchase' THEN 'consumed' WHEN 'signup' THEN 'released' WHEN 'click' THEN 'adjusted_up' ELSE 'adjusted_down' END"


def _ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    cents = F.round(F.col("value").cast("decimal(18,6)") * 100).cast("bigint")
    return table(spark, sf_dir, "events").select("event_id", F.col("user_id"), F.expr(_KIND).alias("kind"), F.greatest(cents, F.lit(1)).alias("amount"), (F.col("event_id") - 1).alias("settles"))


_LEDGER_SQL = f"WITH l AS (SELECT event_id, user_id, {_KIND} AS kind, greatest(CAST(round(CAST(value AS DECIMAL(18,6)) * 100) AS BIGINT), 1) AS amount, event_id - 1 AS settles FROM events)"


@query(_LEDGER_SQL + """, s AS (SELECT DISTINCT settles FROM l WHERE kind IN ('consumed', 'released')),
t AS (SELECT user_id, coalesce(sum(amount) FILTER (kind = 'reserved'), 0) AS reserved,
 coalesce(sum(amount) FILTER (kind IN ('consumed', 'adjusted_up')), 0) - coalesce(sum(amount) FILTER (kind = 'adjusted_down'), 0) AS consumed,
 coalesce(sum(amount) FILTER (kind = 'released'), 0) AS released,
 coalesce(sum(amount) FILTER (kind = 'reserved' AND event_id NOT IN (SELECT settles FROM s)), 0) AS outstanding FROM l GROUP BY user_id)
SELECT user_id, CAST(reserved AS BIGINT) AS reserved, CAST(consumed AS BIGINT) AS consumed, CAST(released AS BIGINT) AS released, CAST(outstanding AS BIGINT) AS outstanding,
 CAST(greatest(500000 - consumed - outstanding, 0) AS BIGINT) AS remaining FROM t""")
def budget_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = budget.usage(_ledger(spark, sf_dir), "user_id", F.lit(500000), entry="event_id")
    return out.select("user_id", *(F.col(c).cast("bigint").alias(c) for c in ("reserved", "consumed", "released", "outstanding", "remaining")))


@query(_LEDGER_SQL + """, r AS (SELECT *, sum(CASE WHEN kind IN ('reserved', 'adjusted_up') THEN amount WHEN kind IN ('released', 'adjusted_down') THEN -amount ELSE 0 END)
 OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS committed FROM l)
SELECT event_id, user_id, amount, CAST(committed AS BIGINT) AS committed FROM r WHERE kind = 'reserved' AND committed > 20000""")
def budget_overcommitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = budget.overcommitted(_ledger(spark, sf_dir), "user_id", F.lit(20000), order="event_id")
    return out.select("event_id", "user_id", "amount", F.col("committed").cast("bigint").alias("committed"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_orderkey IS NOT NULL)")
def unsettled_reservations(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return budget.unsettled(orders, table(spark, sf_dir, "lineitem"), "o_orderkey", "l_orderkey")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, expected FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS expected FROM lineitem) WHERE l_linenumber <> expected""")
def stream_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return streams.gaps(lines, ["l_orderkey"], "l_linenumber", order=["l_linenumber", "l_partkey", "l_suppkey"])


@query("""SELECT event_id, user_id, expected FROM (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS expected FROM events) WHERE event_id <> expected""")
def position_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.gaps(table(spark, sf_dir, "events").select("event_id", "user_id"), ["user_id"], "event_id")


_MAY = {"signup": ("view", "click"), "view": ("click", "purchase", "view"), "click": ("view", "purchase"), "error": ("view", "error"), "purchase": ("view",)}


@query("WITH may(source, target) AS (VALUES " + ", ".join(f"('{s}', '{t}')" for s, ts in _MAY.items() for t in ts) + """),
m AS (SELECT event_id, user_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS source, event_type AS target FROM events)
SELECT event_id, user_id, source, target FROM m WHERE source IS NOT NULL AND NOT EXISTS (SELECT 1 FROM may WHERE may.source = m.source AND may.target = m.target)""")
def illegal_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame([("events", s, t) for s, ts in _MAY.items() for t in ts], "machine string, source string, target string")
    moved = streams.moves(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type"), ["user_id"], "event_id", "event_type").where("source is not null")
    return lifecycle.illegal(moved.withColumn("machine", F.lit("events")), rules).select("event_id", "user_id", "source", "target")


_CAUSE = "CASE WHEN event_id % 7 = 0 THEN event_id + 3 WHEN event_id % 11 = 0 THEN event_id + 100000000 WHEN event_id > 0 THEN event_id - 1 END"


@query(f"""WITH e AS (SELECT event_id, user_id % 2 AS stream, {_CAUSE} AS cause FROM events)
SELECT e.event_id, e.stream, e.cause, CASE WHEN c.event_id IS NULL THEN 'missing_cause' WHEN e.stream <> c.stream THEN 'other_stream' ELSE 'not_prior' END AS problem
FROM e LEFT JOIN e c ON c.event_id = e.cause WHERE e.cause IS NOT NULL AND (c.event_id IS NULL OR e.stream <> c.stream OR c.event_id >= e.event_id)""")
def causation_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 2).alias("stream"), F.expr(_CAUSE).alias("cause"))
    return streams.bad_causes(rows, event="event_id", cause="cause", position="event_id", stream="stream")


@query("""SELECT user_id, count(*) AS n_events, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id""")
def replay_last_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.last_state(table(spark, sf_dir, "events"), ["user_id"], "event_id", "event_type")


@query("""WITH a AS (SELECT o_custkey, count(*) AS n, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS total FROM orders GROUP BY 1),
b AS (SELECT o_custkey, count(*) AS n, sum(CASE WHEN o_totalprice > 300000 THEN 300000 ELSE CAST(o_totalprice AS DECIMAL(18,2)) END) AS total FROM orders GROUP BY 1)
SELECT coalesce(a.o_custkey, b.o_custkey) AS o_custkey, a.n AS l_n, b.n AS r_n,
 CASE WHEN b.o_custkey IS NULL THEN 'only_left' WHEN a.o_custkey IS NULL THEN 'only_right' ELSE concat_ws(',', CASE WHEN a.n <> b.n THEN 'n' END, CASE WHEN a.total <> b.total THEN 'total' END) END AS difference
FROM a FULL JOIN b ON a.o_custkey = b.o_custkey WHERE a.n IS DISTINCT FROM b.n OR a.total IS DISTINCT FROM b.total""")
def projection_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_totalprice").cast("decimal(18,2)").alias("p"))
    fold = lambda rows: rows.groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum("p").alias("total"))
    stored = orders.withColumn("p", F.least("p", F.lit(300000).cast("decimal(18,2)")))  # a store that caps amounts
    return streams.difference(fold(orders), fold(stored), ["o_custkey"], ["n", "total"]).select("o_custkey", "l_n", "r_n", "difference")


_PROFILED = ("p_partkey", "p_name", "p_brand", "p_type", "p_size")


@query("WITH c AS (" + " UNION ALL ".join(f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS cell FROM part" for c in _PROFILED) + r"""),
f AS (SELECT *, cell IS NOT NULL AND trim(cell) <> '' AS ok, try_cast(trim(cell) AS DECIMAL(38,18)) AS num, regexp_full_match(trim(cell), '[+-]?\d+') AS whole FROM c),
g AS (SELECT column_name, count(*) FILTER (ok) AS non_empty, count(*) FILTER (NOT ok) AS missing, count(DISTINCT cell) FILTER (ok) AS distinct_values,
 bool_and(whole) FILTER (ok) AS i, bool_and(num IS NOT NULL) FILTER (ok) AS d, min(cell) FILTER (ok) AS lt, max(cell) FILTER (ok) AS mt, arg_min(cell, (num, cell)) FILTER (ok AND num IS NOT NULL) AS ln, arg_max(cell, (num, cell)) FILTER (ok AND num IS NOT NULL) AS mn FROM f GROUP BY 1)
SELECT column_name, non_empty, missing, distinct_values, CASE WHEN non_empty = 0 THEN 'empty' WHEN i THEN 'integer' WHEN d THEN 'decimal' ELSE 'text' END AS inferred_type, CASE WHEN d THEN ln ELSE lt END AS least_value, CASE WHEN d THEN mn ELSE mt END AS most_value FROM g""")
def column_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.column_profile(table(spark, sf_dir, "part"), list(_PROFILED))


@query("SELECT CAST(sum(n) AS BIGINT) AS row_count, CAST(sum(n - 1) AS BIGINT) AS duplicate_row_count FROM (SELECT text, lang, count(*) AS n FROM documents GROUP BY ALL)")
def duplicate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.table_counts(table(spark, sf_dir, "documents"), ["text", "lang"])


@query(r"SELECT shape, n, example FROM (SELECT regexp_replace(url, '[-+]?\d+(?:\.\d+)?', '#', 'g') AS shape, count(*) AS n, arg_min(url, page_id) AS example FROM pages WHERE url IS NOT NULL GROUP BY 1)")
def member_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.member_shapes(table(spark, sf_dir, "pages").select("page_id", "url").where("url is not null"), "url", "page_id")


_HEADER = "concat(p_name, CASE WHEN p_partkey % 3 = 0 THEN ' [mA/cm^2]' WHEN p_partkey % 3 = 1 THEN ' [V]' ELSE '' END)"


@query(rf"SELECT p_partkey, trim(p_name) AS name, CASE WHEN p_partkey % 3 = 0 THEN 'mA/cm^2' WHEN p_partkey % 3 = 1 THEN 'V' END AS unit FROM part")
def header_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.expr(_HEADER).alias("h")).select("p_partkey", profile.header_name(F.col("h")).alias("name"), profile.header_unit(F.col("h")).alias("unit"))


_UNIT = "CASE l_linenumber WHEN 1 THEN 'mA' WHEN 2 THEN 'uA' WHEN 3 THEN 'A' WHEN 4 THEN 'nA' WHEN 5 THEN 'kA' ELSE 'µA' END"


@query(f"WITH f(u, k) AS (VALUES ('A', 1.0), ('mA', 0.001), ('uA', 0.000001), ('µA', 0.000001), ('nA', 0.000000001)), v AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {_UNIT} AS u, CAST(l_quantity AS DECIMAL(18,2)) AS q FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(CAST(q * CAST(k AS DECIMAL(12,9)) AS DECIMAL(38,9)) AS DOUBLE) AS converted, CASE WHEN k IS NULL THEN 'unsupported_unit_mapping' END AS error FROM v LEFT JOIN f ON f.u = v.u")
def unit_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.expr(_UNIT).alias("source_unit"), F.lit("A").alias("target_unit"), F.col("l_quantity").cast("decimal(18,2)").alias("value"))
    return units.convert(rows, units.factor_table(spark)).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("converted").cast("double").alias("converted"), "error")


@query("""SELECT doc_id, 'record:' || substr(sha256('{"doc_id":' || doc_id || ',"lang":' || CASE WHEN lang IS NULL THEN 'null' ELSE '"' || lang || '"' END || ',"source":' || CASE WHEN source IS NULL THEN 'null' ELSE '"' || source || '"' END || '}'), 1, 32) AS record_id FROM documents""")
def content_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", canonical.flat_content_id("record", doc_id=F.col("doc_id"), source=F.col("source"), lang=F.col("lang")).alias("record_id"))


@query("SELECT o_orderstatus AS status, count(*) AS n, count(*) FILTER (o_totalprice > 200000) AS n_large FROM orders GROUP BY 1")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views_of.counts(table(spark, sf_dir, "orders").withColumnRenamed("o_orderstatus", "status"), "status", n_large=F.col("o_totalprice") > 200000)


@query("SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) % 5 AS code, count(*) AS n FROM events GROUP BY ALL")
def failure_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = (F.get_json_object("props", "$.k").try_cast("bigint") % 5).alias("code")
    return views_of.tally(table(spark, sf_dir, "events").select("event_type", code), "event_type", "code")


@query("""SELECT event_id, user_id, event_type, CASE WHEN event_type = 'error' THEN NULL WHEN row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1 THEN 'accepted' ELSE 'duplicate_suppressed' END AS acceptance FROM events""")
def accept_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    return jobs.accept_once(rows, ["user_id", "event_type"], ["event_id"], F.col("event_type") != "error")


@query("""SELECT n_name, o_orderdate, o_orderkey FROM (SELECT n_name, o_orderdate, o_orderkey, row_number() OVER (PARTITION BY n_name ORDER BY o_orderdate, o_orderkey) AS k
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus = 'O') WHERE k = 1""")
def next_claimable(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select("o_orderkey", "o_custkey", "o_orderdate")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nations = F.broadcast(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"))  # 25 rows by definition
    joined = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    return jobs.next_claimable(joined.select("n_name", "o_orderdate", "o_orderkey"), "n_name", ["o_orderdate", "o_orderkey"], F.lit(True))


@query("""WITH f AS (SELECT o_orderkey, o_orderkey % 13 <> 0 AS there, CASE WHEN o_orderstatus = 'F' THEN 'committed' ELSE 'pending' END AS state, o_orderkey % 7 AS a, CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE o_orderkey % 7 END AS b,
 o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45) AS ref, CASE o_orderkey % 3 WHEN 0 THEN 'duplicate_suppressed' WHEN 1 THEN 'lease_lost' END AS outcome FROM orders)
SELECT o_orderkey, CASE WHEN NOT there THEN 'missing' WHEN a <> b THEN 'quarantined' WHEN ref THEN 'accepted_evidence' WHEN outcome = 'duplicate_suppressed' THEN 'diagnostic_duplicate' ELSE 'diagnostic_orphan' END AS verdict,
 CASE WHEN NOT there AND state = 'committed' THEN 'recorded as committed' WHEN NOT there THEN 'staged, never landed' WHEN a <> b THEN 'checksum differs from the record' WHEN ref THEN 'accepted evidence refers to it'
 WHEN outcome = 'duplicate_suppressed' THEN 'its attempt was a suppressed duplicate' WHEN outcome IS NULL AND state = 'pending' THEN 'never committed' ELSE 'its attempt ended as ' || coalesce(outcome, 'unfinished') END AS reason FROM f""")
def classify_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    seen = evidence.referenced(orders, "o_orderkey", table(spark, sf_dir, "lineitem").where("l_quantity > 45").select("l_orderkey"))
    key = F.col("o_orderkey")
    found = lifecycle.object_verdict(
        key % 13 != 0, F.when(F.col("o_orderstatus") == "F", "committed").otherwise("pending"), key % 7, F.when(key % 5 == 0, F.lit(1)).otherwise(key % 7),
        F.col("referenced"), F.when(key % 3 == 0, "duplicate_suppressed").when(key % 3 == 1, "lease_lost"),
    )
    return seen.select("o_orderkey", found.alias("v")).select("o_orderkey", "v.verdict", "v.reason")


_ORIGIN = "CASE event_type WHEN 'purchase' THEN 2 WHEN 'click' THEN 1 ELSE 0 END"


@query(f"SELECT user_id, field_name, event_id, event_type FROM (SELECT user_id, event_id % 4 AS field_name, event_id, event_type, row_number() OVER (PARTITION BY user_id, event_id % 4 ORDER BY {_ORIGIN} DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def resolve_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", (F.col("event_id") % 4).alias("field_name"), "event_id", "event_type")
    return experiments.resolve_fields(rows, ["user_id", "field_name"], F.expr(_ORIGIN), "event_id")


_STATE = "CASE WHEN event_type = 'error' THEN 'unknown' WHEN event_type = 'signup' THEN 'unavailable' ELSE 'known' END"
_FIELDS = ("f0", "f1", "f2", "f3", "f9")


@query(f"""WITH a AS (SELECT user_id, 'f' || event_id % 6 AS field_name, arg_max({_STATE}, event_id) AS state FROM events GROUP BY ALL),
q(field_name) AS (VALUES {", ".join(f"('{f}')" for f in _FIELDS)}), s AS (SELECT DISTINCT user_id FROM a),
e AS (SELECT coalesce(w.user_id, a.user_id) AS user_id, w.field_name IS NOT NULL AS required, a.state FROM (SELECT * FROM s CROSS JOIN q) w FULL JOIN a ON a.user_id = w.user_id AND a.field_name = w.field_name),
v AS (SELECT user_id, CASE WHEN required AND (state IS NULL OR state <> 'known') THEN 'blocking' WHEN state = 'known' THEN NULL WHEN state = 'unknown' THEN 'unknown' WHEN state = 'unavailable' THEN 'warning' END AS severity FROM e)
SELECT user_id, count(*) FILTER (severity = 'blocking') AS blocking_count, count(*) FILTER (severity = 'unknown') AS unknown_count, count(*) FILTER (severity = 'warning') AS warning_count,
 CASE WHEN count(*) FILTER (severity = 'blocking') > 0 THEN 'blocked' ELSE 'eligible' END AS decision FROM v GROUP BY user_id""")
def release_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", F.concat(F.lit("f"), F.col("event_id") % 6).alias("field_name"), "event_id", F.expr(_STATE).alias("state"))
    active = experiments.resolve_fields(rows, ["user_id", "field_name"], F.lit(0), "event_id").withColumn("requirement_class", F.lit("recommended"))
    return experiments.release_decision(active, experiments.findings(active, _FIELDS, "user_id"), "user_id")


@query("""SELECT conv_id, count(*) FILTER (role = 'assistant') AS assistant, count(*) FILTER (role = 'system') AS system, count(*) FILTER (role = 'user') AS "user" FROM conversations GROUP BY conv_id""")
def role_counts_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    from galvanite.sources.exchange import wide_counts

    return wide_counts(table(spark, sf_dir, "conversations"), ["conv_id"], ["assistant", "system", "user"], field="role")


@query("SELECT p_partkey, field, value FROM (" + " UNION ALL ".join(f"SELECT p_partkey, '{c}' AS field, CAST({c} AS VARCHAR) AS value FROM part" for c in ("p_brand", "p_name", "p_size", "p_type")) + ")")
def round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from galvanite.sources.exchange import from_wide, to_wide

    fields = ["p_brand", "p_name", "p_size", "p_type"]
    long = from_wide(table(spark, sf_dir, "part"), ["p_partkey"], fields)
    return from_wide(to_wide(long, ["p_partkey"], fields), ["p_partkey"], fields)


@query("""SELECT event_id, user_id, CAST(step AS DOUBLE) AS step FROM (SELECT event_id, user_id, CAST(value AS DECIMAL(18,6)) - lag(CAST(value AS DECIMAL(18,6))) OVER (PARTITION BY user_id ORDER BY event_id) AS step FROM events) WHERE step <= 0""")
def monotonic_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    from galvanite.operators.series import not_increasing

    rows = table(spark, sf_dir, "events").select("event_id", "user_id", F.col("value").cast("decimal(18,6)").alias("value"))
    return not_increasing(rows, ["user_id"], ["event_id"], "value").select("event_id", "user_id", F.col("step").cast("double").alias("step"))


@query("""WITH RECURSIVE t AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem), d AS (SELECT l_orderkey, l_linenumber, 0 AS depth FROM t a WHERE NOT EXISTS (SELECT 1 FROM t b WHERE b.l_orderkey = a.l_orderkey AND b.l_linenumber = a.l_linenumber - 1)
UNION ALL SELECT t.l_orderkey, t.l_linenumber, d.depth + 1 FROM d JOIN t ON t.l_orderkey = d.l_orderkey AND t.l_linenumber = d.l_linenumber + 1) SELECT l_orderkey, l_linenumber, CAST(depth AS BIGINT) AS depth FROM d""")
def lineage_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    return evidence.lineage_depth(lines, "l_orderkey", "l_linenumber", F.col("l_linenumber") - 1)


@query("""WITH s AS (SELECT n_regionkey AS graph_id, n_nationkey AS ordinal, 'r' || n_regionkey AS own, 'n' || (n_nationkey - 1) AS before, 'n' || n_nationkey AS made FROM nation),
i AS (SELECT graph_id, ordinal, own AS id FROM s UNION ALL SELECT graph_id, ordinal, before FROM s)
SELECT i.graph_id, i.ordinal, i.id FROM i WHERE i.id NOT LIKE 'r%' AND NOT EXISTS (SELECT 1 FROM s WHERE s.graph_id = i.graph_id AND s.made = i.id AND s.ordinal < i.ordinal)""")
def lineage_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    name = lambda prefix, c: F.concat(F.lit(prefix), c.cast("string"))
    steps = nation.select(F.col("n_regionkey").alias("graph_id"), F.col("n_nationkey").alias("ordinal"), F.array(name("r", F.col("n_regionkey")), name("n", F.col("n_nationkey") - 1)).alias("inputs"), F.array(name("n", F.col("n_nationkey"))).alias("outputs"))
    sources = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("graph_id"), name("r", F.col("r_regionkey")).alias("id"))
    return evidence.unclosed(steps, sources)


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(least(2 * 2 ** (l_linenumber - 1), 300) AS BIGINT) AS wait, CASE WHEN l_linenumber >= 6 THEN 'failed_terminal' WHEN l_returnflag = 'R' THEN 'failed_terminal' ELSE 'available' END AS next_state FROM lineitem""")
def retry_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.when(F.col("l_returnflag") == "R", "invalid_input").otherwise("timeout")
    routed = lifecycle.route_failure(F.lit("running"), F.col("l_linenumber"), F.lit(6), code)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", lifecycle.backoff_seconds(F.col("l_linenumber")).alias("wait"), routed.alias("next_state"))


@query("""SELECT event_type, count(*) AS n, CAST(sum(greatest(event_id % 10 - user_id % 7, 0)) AS BIGINT) AS excess, bool_and(value >= 0) AS all_valid FROM events GROUP BY 1""")
def fault_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_type", "value", (F.col("event_id") % 10).alias("a"), (F.col("user_id") % 7).alias("b"))
    return views_of.excess(rows, "event_type", F.col("a"), F.col("b"), F.col("value") >= 0)


@query("""SELECT key, problem FROM (SELECT p_partkey AS key, 'missing' AS problem FROM part EXCEPT SELECT l_orderkey, 'missing' FROM lineitem)
UNION ALL SELECT key, 'unexpected' FROM (SELECT l_orderkey AS key FROM lineitem EXCEPT SELECT p_partkey FROM part)""")
def set_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    declared = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"))
    return evidence.closed_set(declared, table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key")), "key")


@query("""SELECT 'failure' AS kind, o_orderkey, o_totalprice AS price, CAST(NULL AS VARCHAR) AS priority FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 'recovery', o_orderkey, NULL, o_orderpriority FROM orders WHERE o_orderstatus = 'P'""")
def rows_union_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    failed = orders.where("o_orderstatus = 'F'").select("o_orderkey", F.col("o_totalprice").alias("price"))
    back = orders.where("o_orderstatus = 'P'").select("o_orderkey", F.col("o_orderpriority").alias("priority"))
    return views_of.branches(failure=failed, recovery=back).drop("branch")


@query("""WITH l AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM l)
SELECT user_id, min(ts) AS started, max(ts) + INTERVAL 6 HOUR AS lapsed, count(*) AS n_beats FROM s GROUP BY user_id, k""")
def session_liveness(spark: SparkSession, sf_dir: str) -> DataFrame:
    from galvanite.streaming.liveness import liveness

    return liveness(table(spark, sf_dir, "events"), "user_id", "ts", "6 hours").select("user_id", "started", "lapsed", "n_beats")


@query("""SELECT event_id, user_id, late FROM (SELECT event_id, user_id, coalesce(ts < max(ts) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 1 DAY, false) AS late FROM events)""")
def late_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    from galvanite.operators.series import lateness

    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    return lateness(rows, ["user_id"], "event_id", "ts", "interval 1 day").select("event_id", "user_id", "late")


@query("""WITH a AS (SELECT 'price_not_negative' AS rule, CAST(o_orderkey AS VARCHAR) AS subject FROM orders WHERE NOT (o_totalprice >= 1000)),
b AS (SELECT 'one_order_per_customer_and_day' AS rule, CAST(o_custkey AS VARCHAR) || '|' || CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS subject FROM orders WHERE o_custkey IS NOT NULL GROUP BY o_custkey, CAST(o_orderdate AS DATE) HAVING count(*) > 1),
c AS (SELECT 'customer_is_supplier' AS rule, CAST(o_custkey AS VARCHAR) AS subject FROM orders WHERE o_custkey NOT IN (SELECT s_suppkey FROM supplier))
SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c""")
def constraint_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", F.to_date("o_orderdate").alias("day"))
    return constraints.report(
        constraints.check("price_not_negative", orders, ["o_orderkey"], F.col("o_totalprice") >= 1000),
        constraints.unique("one_order_per_customer_and_day", orders, ["o_custkey", "day"]),
        constraints.foreign("customer_is_supplier", orders, ["o_custkey"], table(spark, sf_dir, "supplier"), ["s_suppkey"]),
    )


from galvanite.plans import campaigns, scalars, views  # noqa: E402, F401 - each registers its queries
from galvanite.plans import evidence as _evidence  # noqa: E402, F401
from galvanite.plans import orders as _orders  # noqa: E402, F401
