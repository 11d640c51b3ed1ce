"""Queries on small tables with the rows on which they once failed, against their SQL."""

import duckdb
from pyspark.sql import functions as F

from galvanite.plans import queries


def against_sql(spark, folder, name):
    """Rows that only Spark has, and those that only DuckDB has."""
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for f in folder.glob("*.parquet"):
        c.execute(f"create view {f.name.removesuffix('.parquet')} as select * from '{f}/*.parquet'")
    frame = queries.QUERIES[name](spark, str(folder))
    result = c.execute(queries.SQL[name])
    names = [d[0] for d in result.description]
    found, wanted = [tuple(r[n] for n in names) for r in frame.collect()], result.fetchall()
    return sorted(set(found) - set(wanted)), sorted(set(wanted) - set(found)), len(found) - len(wanted)


def test_amounts_that_round_to_nothing(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    small = F.when(F.col("event_id") % 3 == 2, 0.001).when(F.col("event_id") % 7 == 6, -1.5).otherwise(F.col("value"))
    events.withColumn("value", small).write.parquet(f"{tmp_path}/events.parquet")
    assert against_sql(spark, tmp_path, "payload_problems") == ([], [], 0)


def test_a_strange_campaign_is_never_the_own_one(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    # the completed attempts that name another campaign: of the campaigns 0, 1 and -1
    events.withColumn("user_id", F.when(F.col("event_id") % 204 == 187, F.floor(F.col("event_id") / 204) % 3 - 1).otherwise(F.col("user_id"))).write.parquet(f"{tmp_path}/events.parquet")
    assert against_sql(spark, tmp_path, "payload_problems") == ([], [], 0)


def test_closed_sets_hold_nulls_and_are_read_once(spark, sf_dir, tmp_path):
    for name, key in (("part", "p_partkey"), ("lineitem", "l_orderkey")):
        rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        rows.withColumn(key, F.when(F.col(key) % 7 != 0, F.col(key))).write.parquet(f"{tmp_path}/{name}.parquet")
    assert against_sql(spark, tmp_path, "set_closure") == ([], [], 0)
    plan = queries.QUERIES["set_closure"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == 2 and "Join" not in plan


def test_more_events_get_more_tasks_and_narrow_rows(spark, monkeypatch):
    from galvanite.operators import replay, tables

    monkeypatch.setattr(replay, "parts_for", lambda *t: tables.parts_for(*t, each=100))
    rows = spark.range(1000).select(F.col("id").alias("event_id"), (F.col("id") % 9).alias("campaign_id"), F.lit("job").alias("aggregate_type"), F.col("id").alias("aggregate_id"), (F.col("id") + 1).alias("sequence"), F.floor(F.col("id") / 9 + 1).alias("campaign_position"),
                                    F.lit("job.enqueued").alias("event_type"), (F.col("id") - 9).alias("causation_id"), F.lit("k").alias("correlation_id"), F.lit("{}").alias("payload"))
    found = replay.violations(rows)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(campaign_id" in plan and ", 10), REPARTITION_BY_NUM" in plan and ", 20), REPARTITION_BY_NUM" in plan
    assert plan.count("Scan") <= 1 and "Union" not in plan  # the windows run once
    # all but the first event of each aggregate's stream have a wrong number; causes fall before the first event for the nine first ones
    assert {r.rule: r["count"] for r in found.groupBy("rule").count().collect()} == {"aggregate_sequence_gap": 999, "incomplete_event_stream": 9, "invalid_event_causation": 9}


def test_proofs_take_one_shuffle_and_paths_one_parse(spark, monkeypatch):
    from galvanite.operators import exchange, mapping

    paths = spark.createDataFrame([(1, "/a"), (1, "/a"), (1, "/b"), (2, "/c"), (2, "/e")], "observation_id long, path string")
    traced = spark.createDataFrame([(1, "/a", "s", "1"), (1, "/a", "s", "1"), (1, "/d", "s", "1"), (2, "/c", "s", "1"), (2, "/c", "s", "2"), (2, "/e", None, "x")], "observation_id long, path string, source_kind string, source_id string")
    found = exchange.proof(paths, traced)
    assert sorted(map(tuple, found.collect())) == [(1, "not_exported", "/d"), (1, "untraced", "/b"), (2, "traced_twice", "/c")]
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    texts = ['{"a": "x\\\\", "b\\"": [1, "\\":"], "c" : {}}', '{"a": "y, \\"z\\": 1", "b\\"": [1, "w"], "c" : {}}', '{"a": "\\x"}', "[]", None, '"s"', '{"a": "1", "a": [2]}']
    rows = spark.createDataFrame(list(enumerate(texts)), "k long, t string").coalesce(1)
    given = sorted(map(tuple, mapping.exported_paths(rows, "k", "t").collect()))
    same = ['/a', '/b"/0', '/b"/1', '/c']
    assert given == sorted([(0, p) for p in same] + [(1, p) for p in same] + [(2, "!"), (3, ""), (4, "!"), (5, ""), (6, "/a/0")])


def test_only_base_rows_and_lists_of_paths_are_shuffled(spark, sf_dir):
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(threshold)
    spark.conf.set(threshold, "-1")  # as with tables too large to be broadcast
    try:
        found = queries.QUERIES["exchange_proof"](spark, sf_dir)
        plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
        assert plan.index("Union") < plan.index("Exchange")  # the rows of paths meet where they were made
        assert all("_orderkey" in e.split(")")[0] or "observation_id" in e.split(")")[0] and "path" not in e.split(")")[0] for e in plan.split("Exchange hashpartitioning(")[1:])
        rows = sorted(map(tuple, found.collect()))
    finally:
        spark.conf.set(threshold, before)
    c = duckdb.connect()
    for t in ("orders", "lineitem"):
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    assert rows == sorted(c.execute(queries.SQL["exchange_proof"]).fetchall())


def test_shapes_tell_texts_apart_as_parsers_do(spark):
    import json

    from galvanite.operators import mapping

    texts = ['["x"]', '["]', '[]', '["x", "y"]', '["x" "y"]', '"', '"s"', '', '{"a" : "x"}', '{"a" "x"}', '{"a": "b", "b": "a"}', '{"b": "b", "b": "a"}', '["a:", ":"]', '{"a": ["\t"]}', '{"a": ["\\t"]}', '{"a": ["t"]}', '{"a": [1]}', '{"a": [12, {}]}', '["\\"]', '["\\\\"]']

    def plain(text):
        try:
            return sorted(set(mapping.leaves(json.loads(text))))
        except ValueError:
            return ["!"]

    rows = spark.createDataFrame(list(enumerate(texts * 2)), "k long, t string").coalesce(1)
    given = sorted(map(tuple, mapping.exported_paths(rows, "k", "t").collect()))
    assert given == sorted((k, p) for k, t in enumerate(texts * 2) for p in plain(t))


def test_cells_meet_all_columns_of_their_series(spark):
    from galvanite.operators import exchange

    series = spark.createDataFrame([(1, "s", 0, "E", "V"), (1, "s", 1, "I", None), (1, "r", 2, "E", "V"), (2, "s", 0, "F", "V"), (3, None, 0, "G", "V"), (None, "s", 0, "H", "V")], "observation_id long, series_id string, at int, source_column string, unit string")
    points = spark.createDataFrame([(1, "s", 0), (1, "s", 7), (2, "r", 0), (3, None, 0), (None, "s", 0), (4, "s", 0)], "observation_id long, series_id string, row int")
    found = {tuple(r) for r in exchange.value_paths(series, points).collect()}
    heads = {(r.observation_id, f"/resources/0/data/header/{r.source_column}", r.series_id) for r in series.collect()}
    assert found == heads | {(1, f"/resources/0/data/rows/{row}/{c}", "s") for row in (0, 7) for c in "EI"}


def test_sound_descriptors_are_judged_as_their_rows_are(spark):
    from test_exchange import evidence

    from galvanite.operators import exchange

    observations, series, points, assertions = evidence(spark)
    observations = observations.unionByName(spark.createDataFrame([("o4", "d.csv"), ("o5", "e.csv"), (None, "f.csv")], observations.schema))
    series = series.unionByName(spark.createDataFrame([("o4", "s4", 0, "E", "V"), ("o4", "s5", 0, "E", "V"), ("o6", "s6", 0, "E", "V"), (None, "s7", 0, "E", None)], series.schema))
    assertions = assertions.unionByName(spark.createDataFrame([("o5", "exchange.source.url", "u", "http://v"), ("o7", "exchange.source.url", "w", "http://w")], assertions.schema))
    others = spark.createDataFrame([("o2", "/nowhere", "assertion", "q"), ("o3", "/name", "assertion", "q"), (None, "/name", "assertion", "q")], "observation_id string, path string, source_kind string, source_id string")
    lost = lambda path: path.like("%/url") & (F.col("observation_id") != "o1")
    documents = exchange.descriptors(observations, series, assertions)
    traced = exchange.traces(observations, series, points, assertions).where(~F.coalesce(lost(F.col("path")), F.lit(False))).unionByName(others)
    wanted = {tuple(r) for r in exchange.proof(exchange.exported(documents, series, points), traced).collect()}
    by_observation = [t.repartition(3, "observation_id") for t in (observations, series, points, assertions, others)]
    found = exchange.judged(exchange.sides(*by_observation, lost, 3)).collect()
    assert {tuple(r) for r in found} == wanted and len(found) == len(wanted)
    assert {("o2", "not_exported", "/nowhere"), ("o3", "traced_twice", "/name"), ("o5", "untraced", exchange.ASSERTED["exchange.source.url"]), ("o6", "not_exported", "/resources/0/schema/fields/0/name")} <= wanted
