"""Queries of the campaign views, budgets and job decisions.

A customer stands for a campaign, an order for a work item and its job, a
line of an order for an attempt."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galvanite.operators import budget, campaigns, evidence, jobs, streams
from galvanite.plans.registry import query, table

ATTEMPTS = """SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS attempt_id, l_orderkey AS work_item_id, l_linenumber AS ordinal,
 CASE l_returnflag WHEN 'A' THEN 'succeeded' WHEN 'N' THEN 'failed_terminal' ELSE CASE l_linestatus WHEN 'F' THEN 'duplicate_suppressed' ELSE 'lease_lost' END END AS status,
 CASE WHEN l_returnflag = 'N' THEN CASE WHEN l_linenumber > 3 THEN 'timeout' ELSE 'invalid_input' END END AS failure,
 CASE WHEN l_linestatus = 'F' THEN CASE l_returnflag WHEN 'A' THEN 'accepted' WHEN 'N' THEN 'corrupted' ELSE 'received' END END AS observed FROM {lineitem}"""
_A = f"a AS ({ATTEMPTS.format(lineitem='lineitem')})"


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(ATTEMPTS, lineitem=table(spark, sf_dir, "lineitem"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("campaign_id"), F.col("o_orderkey").alias("work_item_id"), "o_orderstatus")


def with_campaign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attempts(spark, sf_dir).join(items(spark, sf_dir).select("campaign_id", "work_item_id"), "work_item_id")


@query(f"""WITH {_A}, w AS (SELECT work_item_id, count(*) FILTER (status = 'succeeded') AS s, count(*) FILTER (status = 'failed_terminal') AS f, count(*) AS n FROM a GROUP BY 1),
i AS (SELECT o_custkey, count(*) AS work_items, CAST(coalesce(sum(s), 0) AS BIGINT) AS succeeded, CAST(coalesce(sum(f), 0) AS BIGINT) AS failed, CAST(coalesce(sum(n), 0) AS BIGINT) AS attempts FROM orders LEFT JOIN w ON w.work_item_id = o_orderkey GROUP BY 1)
SELECT c_custkey AS campaign_id, c_name AS name, coalesce(work_items, 0) AS work_items, coalesce(succeeded, 0) AS succeeded, coalesce(failed, 0) AS failed, coalesce(attempts, 0) AS attempts FROM customer LEFT JOIN i ON o_custkey = c_custkey""")
def campaign_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("campaign_id"), F.col("c_name").alias("name"))
    return campaigns.status_view(known, items(spark, sf_dir), attempts(spark, sf_dir), "campaign_id", "work_item_id")


@query(f"WITH {_A} SELECT o_custkey AS campaign_id, status, failure, count(*) AS n FROM a JOIN orders ON o_orderkey = work_item_id GROUP BY ALL")
def outcome_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    return campaigns.tally(with_campaign(spark, sf_dir), "campaign_id", "status", "failure")


@query(f"""WITH {_A}, j AS (SELECT a.*, o_custkey AS campaign_id FROM a JOIN orders ON o_orderkey = work_item_id)
SELECT campaign_id, count(*) AS attempts_created, count(*) FILTER (status = 'succeeded') AS accepted_outcomes, count(*) FILTER (status = 'duplicate_suppressed') AS duplicate_suppressions, coalesce(string_agg(failure, ',' ORDER BY failure), '') AS failure_codes,
 count(*) FILTER (observed = 'received') AS observations_received, count(*) FILTER (observed = 'accepted') AS observations_accepted, count(*) FILTER (observed = 'corrupted') AS corrupted_receipts, count(*) FILTER (ordinal > 2) AS observations_staged FROM j GROUP BY campaign_id""")
def campaign_measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_campaign(spark, sf_dir)
    seen = rows.where("observed is not null").select("campaign_id", F.col("observed").alias("status"))
    out = campaigns.measurements(rows.withColumnRenamed("failure", "failure_code"), seen, rows.where("ordinal > 2").select("campaign_id"), "campaign_id")
    return out.withColumn("failure_codes", F.array_join("failure_codes", ","))


@query(f"""WITH {_A} SELECT 'failure' AS kind, 0 AS branch, attempt_id AS subject, status, failure FROM a WHERE failure IS NOT NULL OR status IN ('corrupted', 'lease_lost', 'timed_out')
UNION ALL SELECT 'recovery', 1, CAST(event_id AS VARCHAR), CASE WHEN event_type = 'error' THEN 'job.lease_expired' ELSE 'job.available' END, CASE WHEN event_type = 'view' THEN 'timeout' END FROM events WHERE event_type IN ('error', 'view')""")
def failures_and_recoveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    log = table(spark, sf_dir, "events").select("event_id", F.when(kind == "error", "job.lease_expired").when(kind.isin("view", "click"), "job.available").otherwise("job.started").alias("event_type"), F.when(kind == "view", "timeout").alias("last_failure"))
    return campaigns.failures_and_recoveries(attempts(spark, sf_dir), log)


@query("""WITH k AS (SELECT o_orderkey, o_custkey, o_orderstatus FROM orders), m AS (SELECT l_orderkey, string_agg('m' || l_linenumber || '=' || CAST(CAST(l_quantity AS BIGINT) AS VARCHAR), ',' ORDER BY 'm' || l_linenumber, CAST(l_quantity AS BIGINT)) AS metrics FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1)
SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_totalprice > 100000 THEN 'obs' || orders.o_orderkey END AS observation_id, coalesce(metrics, '') AS metrics FROM orders LEFT JOIN m ON l_orderkey = o_orderkey""")
def attempt_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    seen = orders.where("o_totalprice > 100000").select("o_orderkey", F.concat(F.lit("obs"), F.col("o_orderkey")).alias("observation_id"))
    found = table(spark, sf_dir, "lineitem").where("l_linestatus = 'F'").select(F.col("l_orderkey").alias("o_orderkey"), F.concat(F.lit("m"), F.col("l_linenumber")).alias("name"), F.col("l_quantity").cast("bigint").alias("value"))
    out = campaigns.attempt_evidence(orders.select("o_orderkey", "o_custkey", "o_orderstatus"), seen, found, ["o_orderkey"])
    return out.withColumn("metrics", F.array_join(F.transform("metrics", lambda m: F.concat_ws("=", m["name"], m["value"].cast("string"))), ","))


@query("""WITH o AS (SELECT o_orderkey, 's3://b/' || o_orderkey AS uri, o_custkey AS size FROM orders), s AS (SELECT l_orderkey, CASE WHEN l_linenumber = 7 THEN NULL ELSE 'b' END AS bucket, CASE WHEN l_returnflag = 'N' THEN 'committed' ELSE 'pending' END AS state FROM lineitem WHERE l_linenumber IN (1, 7)),
j AS (SELECT o_orderkey, l_orderkey, bucket, state FROM o LEFT JOIN s ON l_orderkey = o_orderkey),
g AS (SELECT o_orderkey, count(*) AS n, bool_or(bucket IS NULL) AS none, bool_and(coalesce(bucket = 'b' AND state = 'committed', false)) AS same FROM j GROUP BY 1)
SELECT o_orderkey, CASE WHEN n > 1 THEN 'duplicate_inventory' WHEN none THEN 'no_metadata' ELSE 'inconsistent' END AS problem FROM g WHERE n > 1 OR none OR NOT same""")
def object_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    uri = lambda c: F.concat(F.lit("s3://b/"), F.col(c))
    seen = table(spark, sf_dir, "orders").select("o_orderkey", uri("o_orderkey").alias("object_uri"), F.lit("d").alias("sha256"), F.lit(1).alias("byte_size"))
    kept = table(spark, sf_dir, "lineitem").where("l_linenumber in (1, 7)").select(uri("l_orderkey").alias("object_uri"), F.when(F.col("l_linenumber") != 7, "b").alias("bucket"), F.col("l_orderkey").cast("string").alias("object_key"), F.lit("d").alias("sha256"), F.lit(1).alias("byte_size"), F.when(F.col("l_returnflag") == "N", "committed").otherwise("pending").alias("state"))
    return campaigns.object_problems(seen, kept, ["o_orderkey"])


@query("""WITH u AS (SELECT 'c' || c_custkey AS id FROM customer UNION SELECT 'o' || o_orderkey FROM orders WHERE o_orderstatus = 'F'),
r AS (SELECT 'o' || o_orderkey AS subject_id, CASE WHEN o_totalprice > 150000 THEN 'derived_from' ELSE 'supersedes' END AS predicate, 'c' || o_custkey AS object_id FROM orders),
i AS (SELECT subject_id, predicate, object_id FROM r WHERE subject_id IN (SELECT id FROM u) AND object_id IN (SELECT id FROM u))
SELECT *, false AS made_up FROM i UNION ALL SELECT *, true FROM (SELECT 'o' || o_orderkey, 'derived_from', 'c' || o_custkey FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT * FROM i)""")
def relation_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    name = lambda p, c: F.concat(F.lit(p), F.col(c))
    finished = orders.where("o_orderstatus = 'F'")
    universe = customers.select(name("c", "c_custkey").alias("id")).union(finished.select(name("o", "o_orderkey")))
    relations = orders.select(name("o", "o_orderkey").alias("subject_id"), F.when(F.col("o_totalprice") > 150000, "derived_from").otherwise("supersedes").alias("predicate"), name("c", "o_custkey").alias("object_id"))
    return campaigns.relation_rows(relations, universe, finished.select(name("o", "o_orderkey").alias("subject_id"), name("c", "o_custkey").alias("object_id")))


@query("SELECT DISTINCT sha256(coalesce(lang, source)) AS digest, coalesce(lang, source) AS root FROM documents")
def lineage_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return campaigns.roots(table(spark, sf_dir, "documents"), F.col("lang"), F.col("source"))


@query("""WITH m AS (SELECT l_orderkey, l_linenumber, min(l_quantity) AS q FROM lineitem GROUP BY ALL), o AS (SELECT o_orderkey, 1 AS line FROM orders WHERE o_orderstatus <> 'F')
SELECT l_orderkey, l_linenumber, q FROM m JOIN o ON o_orderkey = l_orderkey AND line = l_linenumber""")
def metrics_of_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_quantity").alias("q"))
    seen = table(spark, sf_dir, "orders").where("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(1).alias("l_linenumber"))
    return found.join(seen, ["l_orderkey", "l_linenumber"])


_ROWS = """SELECT user_id AS run, count(*) FILTER (WHERE event_type = 'purchase') AS accepted_outcomes, count(*) FILTER (WHERE event_type = 'click') AS observations_accepted, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS budget_committed, 200000 AS hard_budget,
 min(event_id) % 2 = 0 AS replay_equal, max(event_id) % 3 > 0 AS package_verified, count(*) FILTER (WHERE event_type = 'error') AS corrupted_receipts, count(*) FILTER (WHERE event_type = 'view') AS duplicate_suppressions FROM {events} GROUP BY user_id"""


@query(f"""WITH r AS ({_ROWS.format(events="events")}), s AS (SELECT count(*) AS campaigns_executed, CAST(sum(greatest(accepted_outcomes - observations_accepted, 0)) AS BIGINT) AS lost_accepted_observations, CAST(sum(greatest(observations_accepted - accepted_outcomes, 0)) AS BIGINT) AS unintended_duplicate_acceptances,
 count(*) FILTER (budget_committed > hard_budget) AS hard_budget_overspends, count(*) FILTER (NOT replay_equal) AS projection_mismatches, count(*) FILTER (NOT package_verified) AS failed_package_verifications, CAST(sum(corrupted_receipts) AS BIGINT) AS corrupted_receipts_retained, CAST(sum(duplicate_suppressions) AS BIGINT) AS duplicate_suppressions FROM r)
SELECT *, lost_accepted_observations + unintended_duplicate_acceptances + hard_budget_overspends + projection_mismatches + failed_package_verifications = 0 AS acceptance_met FROM s""")
def fault_release(spark: SparkSession, sf_dir: str) -> DataFrame:
    return campaigns.fault_summary(spark.sql(_ROWS, events=table(spark, sf_dir, "events")))


@query("SELECT name, n FROM (SELECT 'customer' AS name, count(*) AS n FROM customer UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'part', count(*) FROM part)")
def table_row_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return campaigns.table_counts(**{t: table(spark, sf_dir, t) for t in ("part", "orders", "customer")})


_ENTRY = "CASE event_type WHEN 'purchase' THEN 'consumed' WHEN 'signup' THEN 'released' WHEN 'error' THEN 'adjusted_down' ELSE 'request' END"


@query(f"""WITH l AS (SELECT user_id, event_id, {_ENTRY} AS kind, least(CAST(round(value * 100) AS BIGINT), 9000) AS amount FROM events),
r AS (SELECT *, sum(CASE kind WHEN 'request' THEN 9000 WHEN 'consumed' THEN amount - 9000 WHEN 'released' THEN -9000 WHEN 'adjusted_down' THEN -amount END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS committed FROM l),
o AS (SELECT *, kind = 'request' AND committed > 60000 AS over FROM r), e AS (SELECT *, coalesce(bool_or(over) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS earlier FROM o)
SELECT user_id, event_id, CAST(committed AS BIGINT) AS committed, CASE WHEN earlier THEN 'refused' WHEN over THEN 'exhausts' ELSE 'granted' END AS decision FROM e WHERE kind = 'request'""")
def budget_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = table(spark, sf_dir, "events").select("user_id", "event_id", F.expr(_ENTRY).alias("kind"), F.least(F.round(F.col("value") * 100).cast("bigint"), F.lit(9000)).alias("amount"))
    return budget.decisions(entries, "user_id", F.lit(60000), F.lit(9000), order="event_id").withColumn("committed", F.col("committed").cast("bigint"))


@query("""WITH l AS (SELECT event_id, user_id AS job, event_type, event_id - 3 AS settles FROM events), h AS (SELECT * FROM l WHERE event_type = 'view' AND event_id NOT IN (SELECT settles FROM l WHERE event_type IN ('click', 'signup')))
SELECT job, arg_max(event_id, (event_id % 50, event_id)) AS entry_id, max(event_id % 50) AS lease_generation FROM h GROUP BY job""")
def open_reservations(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "view", "reserved").when(F.col("event_type") == "click", "consumed").when(F.col("event_type") == "signup", "released").otherwise("adjusted_up")
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("entry_id"), F.col("user_id").alias("job"), kind.alias("kind"), (F.col("event_id") - 3).alias("settles"), (F.col("event_id") % 50).alias("lease_generation"), F.lit(1).alias("amount"))
    return budget.open_reservation(rows, "job").select("job", "entry_id", "lease_generation")


@query("""WITH c AS (SELECT event_id, CASE event_type WHEN 'view' THEN 'pause' WHEN 'click' THEN 'resume' WHEN 'error' THEN 'cancel' ELSE 'stop' END AS action, CASE event_id % 5 WHEN 0 THEN 'active' WHEN 1 THEN 'paused' WHEN 2 THEN 'ready' WHEN 3 THEN 'completed' END AS state, user_id AS version, CASE WHEN event_id % 7 = 0 THEN user_id + 1 ELSE user_id END AS expected FROM events),
t AS (SELECT *, CASE action WHEN 'pause' THEN 'paused' WHEN 'resume' THEN 'active' WHEN 'cancel' THEN 'cancelled' END AS target FROM c),
e AS (SELECT *, CASE WHEN state IS NULL THEN 'campaign_not_found' WHEN target IS NULL THEN 'unknown_action' WHEN version <> expected THEN 'expected_version_mismatch' WHEN state || '>' || target NOT IN ('active>paused', 'paused>active', 'ready>active', 'active>cancelled', 'paused>cancelled', 'ready>cancelled') THEN 'illegal_transition' END AS error FROM t)
SELECT event_id, coalesce(error, target) AS outcome, CASE WHEN error IS NULL THEN version + 1 END AS new_version FROM e""")
def control_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, k = F.col("event_type"), F.col("event_id") % 5
    action = F.when(kind == "view", "pause").when(kind == "click", "resume").when(kind == "error", "cancel").otherwise("stop")
    state = F.when(k == 0, "active").when(k == 1, "paused").when(k == 2, "ready").when(k == 3, "completed")
    rows = table(spark, sf_dir, "events").select("event_id", action.alias("action"), state.alias("state"), F.col("user_id").alias("version"), F.when(F.col("event_id") % 7 == 0, F.col("user_id") + 1).otherwise(F.col("user_id")).alias("expected_version"))
    return jobs.controlled(rows).select("event_id", "outcome", "new_version")


@query("""SELECT o_orderkey, 'cancelled' AS state FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_acctbal < 0 AND o_orderstatus IN ('O', 'P')""")
def cancelled_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.col("o_orderstatus")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"), F.when(status == "O", "available").when(status == "P", "retry_scheduled").otherwise("running").alias("state"))
    owners = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_acctbal") < 0, "cancelled").otherwise("active").alias("state"))
    return jobs.cancelled_with_campaign(rows, owners, "c_custkey").select("o_orderkey", "state")


@query("""WITH s AS (SELECT l_orderkey, min(CASE WHEN l_returnflag = 'N' THEN 'x' ELSE 'd' END) AS sha, CAST(count(*) AS BIGINT) AS size FROM lineitem GROUP BY 1)
SELECT o_orderkey, CASE WHEN sha = 'd' AND size < 5 THEN 'committed' ELSE 'quarantined' END AS state, CASE WHEN sha IS NULL THEN 'object_missing' WHEN NOT (sha = 'd' AND size < 5) THEN 'object_readback_mismatch' END AS reason FROM orders LEFT JOIN s ON l_orderkey = o_orderkey""")
def source_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min(F.when(F.col("l_returnflag") == "N", "x").otherwise("d")).alias("sha256"), F.count("*").alias("n"))
    seen = seen.select("o_orderkey", "sha256", F.when(F.col("n") < 5, 1).otherwise(F.col("n")).alias("byte_size"))
    return jobs.source_verdicts(table(spark, sf_dir, "orders").select("o_orderkey", F.lit("d").alias("sha256"), F.lit(1).alias("byte_size")), seen, "o_orderkey")


_JOBS = """SELECT o_orderkey AS job_id, o_custkey AS work_item_id, CASE o_orderstatus WHEN 'O' THEN 'leased' WHEN 'P' THEN 'running' ELSE 'succeeded' END AS state, CASE WHEN o_orderpriority LIKE '1%' THEN NULL ELSE o_orderdate END AS lease_expires_at,
 o_orderkey % 4 AS lease_generation, o_custkey % 5 AS attempt_count, 3 AS max_attempts, o_orderpriority AS lease_token FROM {orders}"""
_AS_OF = "1995-06-17"
_J = f"j AS ({_JOBS.format(orders='orders')})"


def leased(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_JOBS, orders=table(spark, sf_dir, "orders"))


def as_of():
    return F.lit(_AS_OF).cast("timestamp_ntz")


@query(f"""WITH {_J} SELECT job_id, work_item_id, lease_generation + 1 AS lease_generation, CASE WHEN attempt_count >= max_attempts THEN 'failed_terminal' ELSE 'available' END AS state, CASE WHEN attempt_count >= max_attempts THEN 'retry_cap_reached:lease_lost' END AS quarantine_reason
FROM j WHERE state IN ('leased', 'running') AND lease_expires_at <= TIMESTAMP '{_AS_OF}'""")
def expired_leases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.expired_leases(leased(spark, sf_dir), as_of())


@query(f"WITH {_J} SELECT job_id FROM j WHERE state IN ('leased', 'running') AND lease_expires_at > TIMESTAMP '{_AS_OF}' AND lease_generation = 2 AND lease_token LIKE '2%'")
def live_leases(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = leased(spark, sf_dir)
    return jobs.live(rows, F.when(F.col("lease_token").startswith("2"), F.col("lease_token")), F.lit(2), as_of()).select("job_id")


_OPEN = "SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS attempt_id, l_orderkey AS job_id, CASE l_linestatus WHEN 'F' THEN 'running' ELSE 'succeeded' END AS state, CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_shipdate END AS adapter_started_at FROM {lineitem}"


@query(f"""WITH {_J}, a AS ({_OPEN.format(lineitem="lineitem")}) SELECT attempt_id, a.job_id, 'lease_lost' AS state, CASE WHEN adapter_started_at IS NULL THEN 'released' ELSE 'consumed' END AS settlement
FROM a JOIN j ON j.job_id = a.job_id WHERE a.state = 'running' AND (lease_expires_at IS NULL OR lease_expires_at <= TIMESTAMP '{_AS_OF}')""")
def abandoned_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = leased(spark, sf_dir)
    open_ = spark.sql(_OPEN, lineitem=table(spark, sf_dir, "lineitem")).join(rows.select("job_id", "work_item_id"), "job_id")
    return jobs.abandoned_attempts(open_, rows, as_of())


@query(f"""WITH {_J}, a AS ({_OPEN.format(lineitem="lineitem")}), c AS (SELECT DISTINCT attempt_id FROM a JOIN j ON j.job_id = a.job_id WHERE a.state = 'running' AND (lease_expires_at IS NULL OR lease_expires_at <= TIMESTAMP '{_AS_OF}')),
o AS (SELECT DISTINCT attempt_id, attempt_id IN (SELECT attempt_id FROM c) AS closed FROM a) SELECT attempt_id AS object_uri, 'diagnostic_orphan' AS verdict, CASE WHEN closed THEN 'its attempt ended as lease_lost' ELSE 'never committed' END AS reason FROM o""")
def reconciled_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = leased(spark, sf_dir)
    open_ = spark.sql(_OPEN, lineitem=table(spark, sf_dir, "lineitem")).join(rows.select("job_id", "work_item_id"), "job_id")
    ids = spark.sql(_OPEN, lineitem=table(spark, sf_dir, "lineitem")).select("attempt_id").distinct()
    objects = ids.select("attempt_id", F.col("attempt_id").alias("object_uri"), F.lit(True).alias("exists"), F.lit("pending").alias("state"), F.lit("d").alias("recorded"), F.lit("d").alias("observed"), F.lit(False).alias("accepted"), F.lit(None).cast("string").alias("outcome"))
    return jobs.reconciled(rows, open_.dropDuplicates(["attempt_id"]), objects, as_of())["objects"]


@query("SELECT user_id, min(event_id) AS event_id, arg_min(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def enqueued_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.enqueue_once(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id", "event_type")[0]


@query("SELECT user_id, count(DISTINCT event_type) AS targets FROM events GROUP BY user_id HAVING count(DISTINCT event_type) > 1")
def enqueue_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.enqueue_once(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id", "event_type")[1]


@query("""WITH w AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, first_value(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS f FROM events)
SELECT event_id, CASE WHEN n = 1 THEN 'stored' WHEN event_type = f THEN 'replayed' ELSE 'conflict' END AS outcome FROM w""")
def replayed_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.replayed_commands(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type"), ["user_id"], "event_id", "event_type").select("event_id", "outcome")


@query("""WITH g AS (SELECT event_id, user_id, event_id % 9 AS generation, lag(event_id % 9) OVER (PARTITION BY user_id ORDER BY event_id) AS previous FROM events) SELECT event_id, user_id, generation, previous FROM g WHERE generation < previous""")
def falling_generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.falling(table(spark, sf_dir, "events").select("event_id", "user_id", (F.col("event_id") % 9).alias("generation")), ["user_id"], "event_id", "generation")


@query("SELECT l_orderkey, min(l_returnflag) AS least, max(l_returnflag) AS most FROM lineitem GROUP BY 1 HAVING min(l_returnflag) <> max(l_returnflag)")
def changed_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.changed(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag"), ["l_orderkey"], "l_returnflag")


@query("""WITH r AS (SELECT o_orderkey AS k, o_custkey AS size, o_orderstatus AS sha FROM orders), s AS (SELECT l_orderkey AS k, CAST(min(l_suppkey) AS BIGINT) AS size, min(l_linestatus) AS sha FROM lineitem GROUP BY 1)
SELECT coalesce(r.k, s.k) AS path, CASE WHEN s.k IS NULL THEN 'missing' WHEN r.k IS NULL THEN 'unexpected' WHEN r.size <> s.size THEN 'size_mismatch' ELSE 'checksum_mismatch' END AS problem FROM r FULL JOIN s ON r.k = s.k WHERE s.k IS NULL OR r.k IS NULL OR r.size <> s.size OR r.sha <> s.sha""")
def checksum_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    recorded = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("path"), F.col("o_custkey").alias("size"), F.col("o_orderstatus").alias("sha256"))
    observed = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("path")).agg(F.min("l_suppkey").alias("size"), F.min("l_linestatus").alias("sha256"))
    return evidence.checksum_audit(recorded, observed)


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 10)")
def dangling_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return evidence.dangling(rows, table(spark, sf_dir, "part").where("p_size > 10").select(F.col("p_partkey").alias("l_partkey")), "l_partkey")


@query("SELECT o_custkey, count(DISTINCT o_orderpriority) AS units FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderpriority) > 1")
def mixed_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return budget.mixed_units(table(spark, sf_dir, "orders"), "o_custkey", "o_orderpriority")


_LEDGER = """SELECT event_id AS entry_id, user_id AS campaign_id, user_id * 10 AS work_item_id, CASE WHEN event_id % 9 = 0 THEN NULL ELSE user_id * 10 + event_id % 3 END AS job_id, CASE WHEN event_type = 'view' THEN NULL ELSE event_id % 4 END AS attempt_id, event_id % 5 AS lease_generation,
 CASE WHEN event_type IN ('view', 'error') THEN NULL ELSE event_id - 7 END AS reservation_entry_id, CASE event_type WHEN 'view' THEN 'reserved' WHEN 'click' THEN 'consumed' WHEN 'signup' THEN 'adjusted_up' WHEN 'purchase' THEN 'released' ELSE 'spent' END AS kind, CAST(round(value) AS BIGINT) AS amount, CASE WHEN event_id % 11 = 0 THEN '  ' ELSE 'h' END AS unit FROM {events}"""
_HELD = "SELECT o_orderkey AS job_id, o_custkey AS work_item_id, concat('k', o_custkey % 1000) AS idempotency_key, o_custkey % 7 - 1 AS attempt_count, 1 AS lease_generation, CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END AS lease_owner, CASE WHEN o_orderstatus <> 'O' THEN o_orderdate END AS lease_expires_at, CASE WHEN o_orderstatus = 'F' THEN 't' END AS lease_token FROM {orders}"


@query(f"""WITH l AS ({_LEDGER.format(events="events")}), j AS ({_HELD.format(orders="orders")}), s AS (SELECT coalesce(CAST(entry_id AS VARCHAR), '') AS s, * FROM l)
SELECT 'budget_ledger.known_ledger_kind' AS rule, s AS subject FROM s WHERE kind = 'spent' UNION ALL SELECT 'budget_ledger.ledger_amount_positive', s FROM s WHERE amount <= 0 UNION ALL SELECT 'budget_ledger.ledger_unit_present', s FROM s WHERE trim(unit) = ''
UNION ALL SELECT 'budget_ledger.ledger_generation_positive', s FROM s WHERE lease_generation < 1
UNION ALL SELECT 'budget_ledger.ledger_entry_shape', s FROM s WHERE CASE WHEN kind = 'reserved' THEN job_id IS NULL ELSE reservation_entry_id IS NULL OR job_id IS NULL END
UNION ALL SELECT 'budget_ledger.reservation_execution', job_id || '|' || lease_generation FROM l WHERE kind = 'reserved' AND job_id IS NOT NULL GROUP BY job_id, lease_generation HAVING count(*) > 1
UNION ALL SELECT 'budget_ledger.settlement_reservation_identity', reservation_entry_id || '|' || campaign_id || '|' || work_item_id || '|' || job_id || '|' || lease_generation FROM l a WHERE reservation_entry_id IS NOT NULL AND job_id IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM l b WHERE b.entry_id = a.reservation_entry_id AND b.campaign_id = a.campaign_id AND b.work_item_id = a.work_item_id AND b.job_id = a.job_id AND b.lease_generation = a.lease_generation)
UNION ALL SELECT 'budget_ledger.job_work_item', l.job_id || '|' || l.work_item_id FROM l WHERE l.job_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM j WHERE j.job_id = l.job_id AND j.work_item_id = l.work_item_id)
UNION ALL SELECT 'jobs.attempt_count_non_negative', CAST(job_id AS VARCHAR) FROM j WHERE attempt_count < 0 UNION ALL SELECT 'jobs.lease_owner_and_expiry_together', CAST(job_id AS VARCHAR) FROM j WHERE (lease_owner IS NULL) <> (lease_expires_at IS NULL)
UNION ALL SELECT 'jobs.idempotency_key', idempotency_key FROM j GROUP BY idempotency_key HAVING count(*) > 1""")
def catalogue_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from galvanite.operators.catalogue import audit

    ledger = spark.sql(_LEDGER, events=table(spark, sf_dir, "events"))
    held = spark.sql(_HELD, orders=table(spark, sf_dir, "orders"))
    return audit({"budget_ledger": ledger, "jobs": held}, {"budget_ledger": "entry_id", "jobs": "job_id"})


@query("SELECT p_partkey, p_name, CAST(p_size AS VARCHAR) AS size_cell, '[\"' || p_brand || '\",\"' || p_type || '\"]' AS tags FROM part")
def result_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_name", F.col("p_size").cast("string").alias("size_cell"), F.array("p_brand", "p_type").alias("tags"))
    return campaigns.wide_cells(rows)


@query("""SELECT DISTINCT 'L' || (l_orderkey % 5) AS library_id, CAST(l_linenumber AS VARCHAR) AS area_id FROM lineitem""")
def known_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from galvanite.sources.listings import locations

    return locations(table(spark, sf_dir, "lineitem").select(F.concat(F.lit("L"), F.col("l_orderkey") % 5).alias("library_id"), F.col("l_linenumber").cast("string").alias("area_id")))


@query("""SELECT l_orderkey, CASE WHEN count(*) > 4 AND max(l_linenumber) > 6 THEN 'crlf' WHEN count(*) > 4 THEN 'lf' ELSE 'none' END AS ending FROM lineitem GROUP BY 1""")
def line_endings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from galvanite.operators.profile import line_ending

    sums = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.max("l_linenumber").alias("m"))
    text = F.when((F.col("n") > 4) & (F.col("m") > 6), "a\r\nb").when(F.col("n") > 4, "a\nb\nc").otherwise("a")
    return sums.select("l_orderkey", line_ending(text).alias("ending"))
