"""Queries of lineage graphs, ordinals, settlements and the streamed fold."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from galvanite.functions import canonical, lifecycle
from galvanite.operators import evidence, exchange, experiments, lineage, ordinals, replay, settlement
from galvanite.operators.tables import kept, parts_for, shared_folder
from galvanite.plans import campaigns as log
from galvanite.plans import queries as plans
from galvanite.plans.registry import SQL, query, table

_EDGES = """edges AS (SELECT c_custkey AS child, CAST(floor(c_custkey / 2) AS BIGINT) AS parent FROM customer WHERE c_custkey > 1
 UNION SELECT c_custkey, CAST(floor(c_custkey / 3) AS BIGINT) FROM customer WHERE c_custkey > 2 UNION SELECT CAST(floor(c_custkey / 2) AS BIGINT), c_custkey FROM customer WHERE c_custkey % 500 = 3 AND c_custkey > 3)"""


@query(f"""WITH RECURSIVE {_EDGES}, r AS (SELECT child AS record, parent AS ancestor FROM edges UNION SELECT r.record, e.parent FROM r JOIN edges e ON e.child = r.ancestor),
cyclic AS (SELECT DISTINCT record FROM r WHERE record = ancestor), behind AS (SELECT DISTINCT record FROM r WHERE ancestor IN (SELECT record FROM cyclic)),
d AS (SELECT c_custkey AS record, 0 AS n FROM customer WHERE c_custkey NOT IN (SELECT record FROM behind) UNION SELECT e.child, d.n + 1 FROM d JOIN edges e ON e.parent = d.record WHERE e.child NOT IN (SELECT record FROM behind)),
deep AS (SELECT record, max(n) AS depth FROM d GROUP BY record), many AS (SELECT record, count(*) AS k FROM r GROUP BY record)
SELECT c_custkey AS record, CAST(depth AS BIGINT) AS depth, CAST(coalesce(k, 0) AS BIGINT) AS n_ancestors, CASE WHEN c_custkey IN (SELECT record FROM cyclic) THEN 'cycle' WHEN c_custkey IN (SELECT record FROM behind) THEN 'comes_from_cycle' END AS problem
FROM customer LEFT JOIN deep ON deep.record = c_custkey LEFT JOIN many ON many.record = c_custkey""")
def lineage_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer")
    edges = spark.sql(f"WITH {_EDGES.replace('FROM customer', 'FROM {customer}')} SELECT * FROM edges", customer=customer)
    return lineage.depths(edges, customer, key="c_custkey")


@query("SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS ordinal, lag(event_type) OVER (ORDER BY ts, event_id) AS previous_event_type FROM events")
def stream_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as one stream, which no single task orders."""
    rows = table(spark, sf_dir, "events").select(F.lit("all").alias("stream"), "ts", "event_id", "event_type")
    return ordinals.numbered(rows, ["stream"], ["ts", "event_id"], previous=["event_type"]).select("event_id", "ordinal", "previous_event_type")


@query("SELECT user_id AS campaign_id, event_id AS entry_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS line FROM events")
def ledger_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("campaign_id"), F.col("event_id").alias("entry_id"), F.col("ts").alias("recorded_at"))
    return ordinals.numbered(rows, ["campaign_id"], ordinals.LEDGER, name="line").select("campaign_id", "entry_id", "line")


@query("SELECT o_orderkey AS artifact_id, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS line FROM orders WHERE o_orderstatus = 'P'")
def pending_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.lit("pending").alias("state"), F.col("o_orderdate").alias("created_at"), F.col("o_orderkey").alias("artifact_id"))
    return ordinals.numbered(rows, ["state"], ordinals.PENDING, name="line").select("artifact_id", "line")


@query(SQL["release_decision"][: SQL["release_decision"].index("v AS (")].replace("SELECT user_id, CASE", "") + """v AS (SELECT user_id, coalesce(e.field_name, '') AS field_name, CASE WHEN required AND (state IS NULL OR state <> 'known') THEN 'blocking' WHEN state = 'known' THEN NULL WHEN state = 'unknown' THEN 'unknown' WHEN state = 'unavailable' THEN 'warning' END AS severity
 FROM (SELECT coalesce(w.user_id, a.user_id) AS user_id, coalesce(w.field_name, a.field_name) AS field_name, w.field_name IS NOT NULL AS required, a.state FROM (SELECT * FROM s CROSS JOIN q) w FULL JOIN a ON a.user_id = w.user_id AND a.field_name = w.field_name) e)
SELECT user_id, field_name, severity, row_number() OVER (PARTITION BY user_id ORDER BY severity, field_name) AS line FROM v WHERE severity IS NOT NULL""")
def findings_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings as a report lists them: by severity as text, then by field."""
    rows = table(spark, sf_dir, "events").select("user_id", F.concat(F.lit("f"), F.col("event_id") % 6).alias("field_name"), "event_id", F.expr(plans._STATE).alias("state"))  # noqa: SLF001
    active = experiments.resolve_fields(rows, ["user_id", "field_name"], F.lit(0), "event_id").withColumn("requirement_class", F.lit("recommended"))
    found = experiments.findings(active, plans._FIELDS, "user_id")  # noqa: SLF001
    return ordinals.numbered(found, ["user_id"], ordinals.FINDINGS, name="line").select("user_id", "field_name", "severity", "line")


_STEPS = """(SELECT CAST(floor(event_id / 5) AS BIGINT) % 97 AS campaign_id, event_id AS position, CASE event_id % 5 WHEN 0 THEN 'reserve' WHEN 4 THEN 'reserve' WHEN 3 THEN 'release' ELSE 'consume' END AS instruction,
 CASE event_id % 5 WHEN 4 THEN event_id ELSE event_id - event_id % 5 END AS reservation_id, user_id % 2 AS attempt_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE CAST(event_id % 11 AS DECIMAL(28, 9)) END AS actual FROM {events})"""


@query(f"""WITH i AS (SELECT *, CASE WHEN instruction = 'release' THEN 10 ELSE coalesce(actual, 10) END AS said FROM {_STEPS.format(events='events')} x),
a AS (SELECT *, min(CASE WHEN instruction = 'reserve' THEN position END) OVER w AS at_ FROM i WINDOW w AS (PARTITION BY campaign_id, reservation_id)),
b AS (SELECT *, min(CASE WHEN instruction <> 'reserve' AND position > at_ AND said > 0 THEN position END) OVER w AS first_ FROM a WINDOW w AS (PARTITION BY campaign_id, reservation_id)),
c AS (SELECT b.*, f.instruction AS kind_, f.attempt_id AS who_, f.said AS recorded FROM b LEFT JOIN b f ON f.campaign_id = b.campaign_id AND f.reservation_id = b.reservation_id AND f.position = b.first_),
d AS (SELECT *, coalesce(position > first_ AND instruction = 'consume' AND kind_ = 'consume' AND attempt_id IS NOT DISTINCT FROM who_, FALSE) AS same, CASE WHEN actual <> 0 THEN actual END AS given FROM c),
e AS (SELECT *, min(CASE WHEN same AND coalesce(given, recorded) <> recorded THEN position END) OVER w AS adj FROM d WINDOW w AS (PARTITION BY campaign_id, reservation_id)),
f AS (SELECT e.*, n.given AS new_ FROM e LEFT JOIN e n ON n.campaign_id = e.campaign_id AND n.reservation_id = e.reservation_id AND n.position = e.adj),
g AS (SELECT *, CASE WHEN position > adj THEN new_ ELSE recorded END AS now_, CASE WHEN instruction = 'reserve' THEN CASE WHEN position = at_ THEN 'reserved' END WHEN position = first_ THEN CASE WHEN instruction = 'consume' THEN 'consumed' ELSE 'released' END
  WHEN position = adj THEN CASE WHEN given > recorded THEN 'adjusted_up' ELSE 'adjusted_down' END END AS entry FROM f),
h AS (SELECT *, CASE entry WHEN 'reserved' THEN 10 WHEN 'adjusted_up' THEN given - recorded WHEN 'adjusted_down' THEN recorded - given WHEN 'consumed' THEN said WHEN 'released' THEN said END AS amount,
  CASE WHEN entry IS NOT NULL THEN NULL WHEN instruction = 'reserve' THEN 'repeated' WHEN NOT coalesce(position > at_, FALSE) THEN 'no_reservation' WHEN first_ IS NULL OR position < first_ THEN 'amount_not_positive' WHEN same AND coalesce(given, now_) = now_ THEN 'repeated' ELSE 'reservation_settled' END AS problem FROM g),
k AS (SELECT *, sum(CASE entry WHEN 'reserved' THEN 10 WHEN 'consumed' THEN amount - 10 WHEN 'released' THEN -10 WHEN 'adjusted_up' THEN amount WHEN 'adjusted_down' THEN -amount ELSE 0 END) OVER (PARTITION BY campaign_id ORDER BY position) AS committed FROM h),
l AS (SELECT *, coalesce(entry = 'reserved' AND committed > 200, FALSE) OR coalesce(CASE WHEN entry = 'consumed' THEN amount WHEN position = adj THEN given END > 10, FALSE) AS over_ FROM k),
m AS (SELECT *, min(CASE WHEN over_ THEN position END) OVER (PARTITION BY campaign_id) AS end_ FROM l),
n AS (SELECT *, bool_or(position = end_ AND entry = 'reserved') OVER (PARTITION BY campaign_id) AS by_request FROM m),
o AS (SELECT *, coalesce(entry = 'reserved' AND position >= end_ AND (position > end_ OR by_request), FALSE) AS no_, coalesce(instruction <> 'reserve' AND (at_ > end_ OR (at_ = end_ AND by_request)), FALSE) AS never FROM n)
SELECT campaign_id, position, reservation_id, CASE WHEN NOT no_ AND NOT never THEN entry END AS entry, CAST(CASE WHEN NOT no_ AND NOT never THEN amount END AS DOUBLE) AS amount,
 CASE WHEN no_ THEN 'refused' WHEN never THEN 'no_reservation' ELSE problem END AS problem, over_ AND NOT never AND NOT (no_ AND position > end_) AS exhausts FROM o""")
def settled_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = spark.sql(f"SELECT * FROM {_STEPS}", events=table(spark, sf_dir, "events"))
    return settlement.settled(steps, F.lit(200), F.lit(10)).withColumn("amount", F.col("amount").cast("double"))


@query("""SELECT p_partkey, 'part:' || substr(sha256('{"a":["' || p_name || '",null,' || p_size || '],"z":{"brand":"' || p_brand || '","deep":{"type":"' || p_type || '"}}}'), 1, 32) AS content_id FROM part""")
def nested_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identities of nested documents whose keys come in another order."""
    document = F.concat(F.lit('{"z": {"deep": {"type": "'), "p_type", F.lit('"}, "brand": "'), "p_brand", F.lit('"}, "a": ["'), "p_name", F.lit('", null, '), F.col("p_size").cast("string"), F.lit("]}"))
    return canonical.with_content_id(table(spark, sf_dir, "part").select("p_partkey", document.alias("t")), "t", "part").drop("t")


@query("""WITH a AS (SELECT l_suppkey % 50 AS k, count(*) AS n FROM lineitem WHERE l_linenumber < 4 GROUP BY 1), b AS (SELECT l_suppkey % 50 AS k, count(*) AS n FROM lineitem WHERE l_linenumber > 1 AND l_suppkey % 50 <> 7 GROUP BY 1)
SELECT coalesce(a.k, b.k) AS key, CAST(coalesce(a.n, 0) AS BIGINT) AS n_left, CAST(coalesce(b.n, 0) AS BIGINT) AS n_right FROM a FULL JOIN b ON a.k = b.k WHERE coalesce(a.n, 0) <> coalesce(b.n, 0)""")
def multiset_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").withColumn("key", F.col("l_suppkey") % 50)
    return evidence.multiset_difference(rows.where("l_linenumber < 4"), rows.where("l_linenumber > 1 and l_suppkey % 50 <> 7"), ["key"])


_MOVES = "(VALUES " + ", ".join(f"('{m}', '{s}', '{t}')" for m, states in lifecycle.TRANSITIONS.items() for s, targets in states.items() for t in targets) + ") AS t(machine, source, target)"


@query(f"""WITH log AS ({log.LOG.format(events='events')}), last AS (SELECT aggregate_type AS machine, arg_max(state, event_id) AS state FROM log WHERE state IS NOT NULL GROUP BY campaign_id, aggregate_type, aggregate_id)
SELECT last.machine, last.state, count(*) AS n_aggregates FROM last WHERE EXISTS (SELECT 1 FROM {_MOVES} WHERE t.machine = last.machine AND t.target = last.state) AND NOT EXISTS (SELECT 1 FROM {_MOVES} WHERE t.machine = last.machine AND t.source = last.state) GROUP BY ALL""")
def terminal_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many aggregates of the log have come to an end, by their state."""
    last = replay.projections(log.log(spark, sf_dir).withColumns({"payload": log._payload(), "sequence": F.col("event_id")})).withColumnRenamed("aggregate_type", "machine")  # noqa: SLF001
    return last.join(F.broadcast(lifecycle.terminal_states(lifecycle.transition_table(spark))), ["machine", "state"], "left_semi").groupBy("machine", "state").agg(F.count("*").alias("n_aggregates"))


_PACKAGES = """SELECT o_orderkey AS package_id, o_custkey + CASE WHEN o_orderkey % 50 = 0 THEN 100000000 ELSE 0 END AS passport_id, o_custkey % 300 AS experiment_id, o_orderkey % 40 AS experiment_version, CAST(o_orderkey % 5 AS {text}) AS schema_version,
 CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey - 1 END AS supersedes_package_id, concat('u', o_orderkey % 997) AS object_uri, CAST(floor(o_totalprice) AS BIGINT) % 20 AS archive_byte_size FROM {orders}"""
_PASSPORTS = "SELECT c_custkey AS passport_id, c_custkey % 300 AS experiment_id, c_custkey % 7 AS experiment_version, CAST(c_custkey % 2 AS {text}) AS schema_version, CASE WHEN c_custkey % 11 = 0 THEN c_custkey + 500 END AS supersedes_passport_id FROM {customer}"
_OBJECTS = "SELECT concat('u', p_partkey) AS object_uri, 'pending' AS state, NULL AS sha256, NULL AS byte_size, NULL AS committed_at, NULL AS classification, NULL AS reconciled_at, NULL AS classification_reason FROM {part} WHERE p_partkey < 900"


@query(f"""WITH k AS ({_PACKAGES.format(text='VARCHAR', orders='orders')}), p AS ({_PASSPORTS.format(text='VARCHAR', customer='customer')}), o AS ({_OBJECTS.format(part='part')})
SELECT 'experiment_packages.known_experiment_package_schema' AS rule, CAST(package_id AS VARCHAR) AS subject FROM k WHERE schema_version NOT IN ('1', '2', '3') UNION ALL SELECT 'experiment_packages.experiment_package_not_empty', CAST(package_id AS VARCHAR) FROM k WHERE archive_byte_size < 1
UNION ALL SELECT 'experiment_passports.known_passport_schema', CAST(passport_id AS VARCHAR) FROM p WHERE schema_version <> '1'
UNION ALL SELECT 'experiment_packages.experiment_version', experiment_id || '|' || experiment_version FROM k GROUP BY experiment_id, experiment_version HAVING count(*) > 1 UNION ALL SELECT 'experiment_passports.experiment_version', experiment_id || '|' || experiment_version FROM p GROUP BY experiment_id, experiment_version HAVING count(*) > 1
UNION ALL SELECT 'experiment_passports.supersedes_passport', CAST(supersedes_passport_id AS VARCHAR) FROM p WHERE supersedes_passport_id IS NOT NULL AND supersedes_passport_id NOT IN (SELECT passport_id FROM p)
UNION ALL SELECT 'experiment_packages.supersedes_package', CAST(supersedes_package_id AS VARCHAR) FROM k WHERE supersedes_package_id IS NOT NULL AND supersedes_package_id NOT IN (SELECT package_id FROM k)
UNION ALL SELECT 'experiment_packages.passport', CAST(passport_id AS VARCHAR) FROM k WHERE passport_id NOT IN (SELECT passport_id FROM p) UNION ALL SELECT 'experiment_packages.object', object_uri FROM k WHERE object_uri NOT IN (SELECT object_uri FROM o)""")
def package_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from galvanite.operators.catalogue import audit

    packages = spark.sql(_PACKAGES.replace("{text}", "STRING"), orders=table(spark, sf_dir, "orders"))
    passports = spark.sql(_PASSPORTS.replace("{text}", "STRING"), customer=table(spark, sf_dir, "customer"))
    stored = spark.sql(_OBJECTS, part=table(spark, sf_dir, "part"))
    return audit({"experiment_packages": packages, "experiment_passports": passports, "storage_objects": stored}, {"experiment_packages": "package_id", "experiment_passports": "passport_id", "storage_objects": "object_uri"})


@query(f"""SELECT o_orderkey AS observation_id, 'untraced' AS problem, '{exchange.ASSERTED["exchange.source.url"]}' AS path FROM orders WHERE o_orderkey % 17 = 0 UNION ALL SELECT o_orderkey, 'not_exported', '/nowhere' FROM orders WHERE o_orderkey % 19 = 0
UNION ALL SELECT l_orderkey, 'traced_twice', '/resources/0/data/rows/0/c1' FROM lineitem WHERE l_orderkey % 23 = 0 AND l_orderkey IN (SELECT o_orderkey FROM orders) GROUP BY l_orderkey HAVING count(*) > 1""")
def exchange_proof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of all orders and the sources of their paths, some of which are lost, invented or named twice."""
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    parts = parts_for(orders, lines, each=50_000)  # a line has some 15 paths on both sides
    # both tables are shuffled once, narrow, by observation; the paths that are made of them stay where they are.
    # All uses of the lines need the same columns, and so share a shuffle
    orders = orders.repartition(parts, "o_orderkey")
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")) - 1
    lines = lines.repartition(parts, "l_orderkey").withColumn("at", place.cast("int"))
    lines = lines.join(orders.select(F.col("o_orderkey").alias("l_orderkey")).distinct(), "l_orderkey")  # a semi-join would be moved before the shuffle
    observations = orders.select(F.col("o_orderkey").alias("observation_id"), F.concat(F.lit("f"), "o_custkey").alias("filename"))
    name = F.concat_ws("-", "l_orderkey", "at")
    series = lines.select(F.col("l_orderkey").alias("observation_id"), name.alias("series_id"), "at", F.concat(F.lit("c"), "at").alias("source_column"), F.col("l_returnflag").alias("unit"))
    points = lines.select(F.col("l_orderkey").alias("observation_id"), name.alias("series_id"), F.lit(0).alias("row"))
    said = lambda field, value: F.struct(F.lit(field).alias("field_name"), F.concat(F.lit("a"), "o_orderkey", F.lit(field)).alias("assertion_id"), value.alias("value"))
    fields = F.array(said("exchange.source.url", F.col("o_orderpriority")), said("exchange.experimental", F.when(F.col("o_orderstatus") == "F", "yes")))
    assertions = orders.select(F.col("o_orderkey").alias("observation_id"), F.inline(fields))
    more = lambda rows, path: rows.select("observation_id", F.lit(path).alias("path"), F.lit("assertion").alias("source_kind"), F.lit("x").alias("source_id"))
    invented = more(observations.where("observation_id % 19 = 0"), "/nowhere")
    second = more(series.where("at = 1 and observation_id % 23 = 0"), "/resources/0/data/rows/0/c1")
    lost = lambda path: path.like("%/url") & (F.col("observation_id") % 17 == 0)
    return exchange.judged(exchange.sides(observations, series, points, assertions, invented.unionByName(second), lost, parts))


_ITEM = {"campaigns": "''", "work_items": "CAST(work_item_id AS VARCHAR)", "jobs": "CAST(job_id AS VARCHAR)", "attempts": "CAST(attempt_id AS VARCHAR)", "observations": "concat_ws('|', attempt_id, observation_id)"}
_FIELD = {
    "campaigns": "name, environment_id, epoch_us(created_at), state, epoch_us(updated_at)", "work_items": "candidate_id, epoch_us(created_at), state, quarantine_reason, epoch_us(updated_at)",
    "jobs": "work_item_id, max_attempts, command_version, idempotency_key, state, lease_owner, lease_expires_at, lease_generation, attempt_count, last_failure, last_event_id",
    "attempts": "work_item_id, job_id, ordinal, status, observation_id, failure, state", "observations": "work_item_id, object_uri, byte_size, sha256, status",
}
_PARTS = " UNION ALL ".join(f"SELECT '{name}' AS section, campaign_id, {_ITEM[name]} AS subject, concat_ws('|', {_FIELD[name]}) AS fields FROM ({SQL[f'replay_{name}']}) {name}_" for name in _ITEM)


@query(f"""{_PARTS} UNION ALL SELECT 'budget', campaign_id, '', concat_ws('|', reserved, consumed, 0, 0, 0, outstanding, 'h') FROM (
 SELECT campaign_id, coalesce(sum(amount) FILTER (t = 2), 0) AS reserved, coalesce(sum(amount) FILTER (t = 8), 0) AS consumed, coalesce(sum(amount) FILTER (t = 2 AND settled IS NULL), 0) AS outstanding FROM (
  SELECT m.*, s.settles AS settled FROM ({log.LOG.format(events='events')}) m LEFT JOIN (SELECT DISTINCT campaign_id, settles FROM ({log.LOG.format(events='events')}) x WHERE t = 8) s ON s.campaign_id = m.campaign_id AND s.settles = m.event_id WHERE t IN (2, 8)) b GROUP BY campaign_id) c""")
def streamed_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The campaign log as a stream of batches, folded by keyed state into a
    table that takes each batch once."""
    from galvanite.operators.replay import SECTIONS
    from galvanite.streaming import campaigns as stream
    from galvanite.streaming.sinks import KeyedTable

    events = log.log(spark, sf_dir)
    parts = max(5, parts_for(events, each=200_000))  # files and parts of the table, so tasks, grow with the log
    events = ordinals.numbered(events, ["campaign_id"], ["event_id"], name="_at")
    # payloads are made once, after the ranges; the files cut across campaigns
    events = events.select("campaign_id", F.col("_at").alias("campaign_position"), "aggregate_type", "aggregate_id", "event_id", "event_type", "occurred_at", log._payload().alias("payload"))  # noqa: SLF001
    events = kept(events.repartition(parts, F.pmod("event_id", F.lit(parts))))
    folder = f"{shared_folder(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    target = KeyedTable(spark, f"{folder}/table", stream.FOLDED, ["campaign_id", "section", "key"], "applied", buckets=max(16, parts))
    store = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(store)
    stream.with_rocksdb(spark)
    try:
        source = spark.readStream.schema(events.schema).parquet(events.inputFiles()[0].rsplit("/", 1)[0])
        running = stream.fold(source).writeStream.outputMode("update").foreachBatch(lambda rows, batch: target.upsert(rows, batch)).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
        running.awaitTermination()
    finally:
        spark.conf.set(store, before)
    found = stream.sections(target.read())

    def text(name: str, kind: str) -> Column:
        c = F.col(name)
        return (F.unix_micros(c) if kind == "timestamp" else c.cast("long") if kind.startswith("decimal") else c).cast("string")

    texts = []
    for name, (keys, fixed, free) in SECTIONS.items():
        rows, kinds = found[name], dict(found[name].dtypes)
        texts.append(rows.select(F.lit(name).alias("section"), F.col("campaign_id").cast("long").alias("campaign_id"), F.concat_ws("|", *keys[1:]).alias("subject"), F.concat_ws("|", *(text(c, kinds[c]) for c in fixed + free)).alias("fields")))
    out = texts[0]
    for more in texts[1:]:
        out = out.unionByName(more)
    return out
