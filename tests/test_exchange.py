import json

from pyspark.sql import functions as F

from galvanite.operators import exchange
from galvanite.sources.exchange import from_wide, to_wide


def evidence(spark):
    observations = spark.createDataFrame([("o1", "a.csv"), ("o2", None), ("o3", "c.csv")], "observation_id string, filename string")
    series = spark.createDataFrame([("o1", "s1", 0, "E", "V"), ("o1", "s2", 1, "I \"x\"", "A"), ("o2", "s3", 0, "E", None)], "observation_id string, series_id string, at int, source_column string, unit string")
    points = spark.createDataFrame([("o1", s, k, v) for s, vs in (("s1", ("0.10", "0.2")), ("s2", ("1", "2.00"))) for k, v in enumerate(vs)] + [("o2", "s3", 0, "5")], "observation_id string, series_id string, row int, value string")
    said = [("o1", f, f"x{i}", f"v{i}") for i, f in enumerate(exchange.ASSERTED)] + [("o2", "exchange.source.url", "y", "http://u"), ("o2", "other", "z", "no"), ("o3", "exchange.experimental", "w", None)]
    return observations, series, points, spark.createDataFrame(said, "observation_id string, field_name string, assertion_id string, value string")


def test_every_exported_path_is_traced_both_ways(spark):
    observations, series, points, assertions = evidence(spark)
    documents = exchange.descriptors(observations, series, assertions)
    found = {r.observation_id: json.loads(r.descriptor) for r in documents.collect()}
    inner = found["o1"]["resources"][0]["metadata"]["echemdb"]
    assert inner["source"] == {"citationKey": "v0", "url": "v1", "originalFilename": "a.csv"} and inner["system"]["electrolyte"] == {"type": "v3"}
    assert [f["name"] for f in found["o1"]["resources"][0]["schema"]["fields"]] == ["E", 'I "x"']
    assert found["o2"]["resources"][0]["schema"]["fields"] == [{"name": "E", "type": "number"}] and found["o3"]["resources"][0]["schema"]["fields"] == []
    paths, traced = exchange.exported(documents, series, points), exchange.traces(observations, series, points, assertions)
    assert paths.where("observation_id = 'o1' and path like '/resources/0/data/rows/%'").count() == 4
    assert exchange.proof(paths, traced).collect() == []
    less = traced.where("not (observation_id = 'o1' and path like '%/url')")
    more = less.unionByName(spark.createDataFrame([("o2", "/nowhere", "assertion", "q"), ("o2", "/name", "assertion", "q")], traced.schema))
    assert sorted(map(tuple, exchange.proof(paths, more).collect())) == [("o1", "untraced", exchange.ASSERTED["exchange.source.url"]), ("o2", "not_exported", "/nowhere"), ("o2", "traced_twice", "/name")]


def test_wide_tables_come_back_as_they_were(spark):
    _, series, points, _ = evidence(spark)
    long = points.join(series, ["observation_id", "series_id"]).where("observation_id = 'o1'").select("observation_id", "row", F.col("source_column").alias("field"), "value")
    columns = ["E", 'I "x"']
    back = from_wide(to_wide(long, ["observation_id", "row"], columns), ["observation_id", "row"], ["E", '`I "x"`'.strip("`")])
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, long.collect()))
