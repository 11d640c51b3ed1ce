"""Exchange documents of observations, with the proof of where each exported
path comes from.

An exchange is a descriptor (nested JSON), a wide table of the series' values
and a trace of each path in either: the assertion, the series or the
observation that it was copied from. The proof goes both ways: no exported
path without a trace, and no trace of what wasn't exported."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from galvanite.operators import mapping

_META = "/resources/0/metadata/echemdb"
#: Asserted field -> path in the descriptor.
ASSERTED = {
    "exchange.source.citation_key": f"{_META}/source/citationKey",
    "exchange.source.url": f"{_META}/source/url",
    "exchange.system.type": f"{_META}/system/type",
    "exchange.electrolyte.type": f"{_META}/system/electrolyte/type",
    "exchange.figure.type": f"{_META}/figureDescription/type",
    "exchange.measurement_type": f"{_META}/figureDescription/measurementType",
    "exchange.curation.process": f"{_META}/curation/process",
    "exchange.experimental": f"{_META}/experimental",
    "exchange.electrodes": f"{_META}/system/electrodes",
}
FIELD_LISTS = ("/resources/0/schema/fields", f"{_META}/figureDescription/fields")
FILENAME = f"{_META}/source/originalFilename"


def descriptors(observations: DataFrame, series: DataFrame, assertions: DataFrame) -> DataFrame:
    """(observation_id, descriptor): one nested document for each observation.

    ``observations`` has (observation_id, filename), ``series``
    (observation_id, series_id, at, source_column, unit; at counts from 0),
    ``assertions`` (observation_id, field_name, assertion_id, value). What
    isn't asserted is absent; an observation without series has empty lists."""
    return _gathered(observations, series, assertions).where("known").select("observation_id", _descriptor().alias("descriptor"))


def _gathered(observations: DataFrame, series: DataFrame, assertions: DataFrame) -> DataFrame:
    """(observation_id, known, filename, s, said, values, fields): a row for
    each observation, with its series in order and its assertions. Those that
    ``observations`` lacks are not known. Partitioned tables are not shuffled."""
    said = assertions.where(F.col("field_name").isin(*ASSERTED))
    parts = {"_o": (observations, "filename"), "_s": (series, "at source_column unit series_id"), "_a": (said, "field_name value assertion_id")}
    rows = [t.select("observation_id", F.struct(*names.split()).alias(n)) for n, (t, names) in parts.items()]
    lists = {n: F.collect_list(n).alias(n) for n in parts}
    each = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows).groupBy("observation_id").agg(*lists.values())
    each = each.select("observation_id", F.explode_outer("_o").alias("o"), F.sort_array("_s").alias("s"), F.col("_a").alias("said"))
    values = F.map_from_entries(F.transform("said", lambda a: F.struct(a["field_name"], a["value"])))
    fields = F.transform("s", lambda x: F.struct(x["source_column"].alias("name"), F.lit("number").alias("type"), x["unit"].alias("unit")))
    return each.select("observation_id", F.col("o").isNotNull().alias("known"), "o.filename", "s", "said", values.alias("values"), fields.alias("fields"))


def _descriptor() -> Column:
    """The document of a row of ``_gathered``."""
    value = lambda f: F.try_element_at("values", F.lit(f))
    of = lambda **parts: F.struct(*(c.alias(k) for k, c in parts.items()))
    echemdb = of(
        source=of(citationKey=value("exchange.source.citation_key"), url=value("exchange.source.url"), originalFilename=F.col("filename")),
        system=of(type=value("exchange.system.type"), electrolyte=of(type=value("exchange.electrolyte.type")), electrodes=value("exchange.electrodes")),
        figureDescription=of(type=value("exchange.figure.type"), measurementType=value("exchange.measurement_type"), fields=F.col("fields")),
        curation=of(process=value("exchange.curation.process")), experimental=value("exchange.experimental"),
    )
    name = F.concat(F.lit("observation-"), F.col("observation_id"))
    resource = of(name=name, path=F.concat(name, F.lit(".csv")), schema=of(fields=F.col("fields")), metadata=of(echemdb=echemdb))
    return F.to_json(of(name=name, resources=F.array(resource)))


def value_paths(series: DataFrame, points: DataFrame) -> DataFrame:
    """(observation_id, path, series_id) of the wide table: a path for each
    column's header and each cell. ``points`` has (observation_id, series_id, row).
    Tables that are both partitioned by observation_id are not shuffled."""
    # a window over both tables, as a join by two keys would shuffle by both
    heads = series.select("observation_id", "series_id", F.struct("source_column").alias("_head"), F.lit(None).alias("row"))
    cells = points.where("observation_id is not null and series_id is not null").select("observation_id", "series_id", F.lit(None).alias("_head"), "row")
    columns = F.collect_set("_head").over(Window.partitionBy("observation_id", "series_id"))
    rows = heads.unionByName(cells).withColumn("_columns", columns)
    each = rows.select("*", F.explode(F.when(F.col("_head").isNotNull(), F.array("_head")).otherwise(F.col("_columns"))).alias("_c"))
    place = F.when(F.col("_head").isNotNull(), F.lit("header/")).otherwise(F.concat(F.lit("rows/"), F.col("row").cast("string"), F.lit("/")))
    return each.select("observation_id", F.concat(F.lit("/resources/0/data/"), place, F.col("_c.source_column")).alias("path"), "series_id")


def exported(documents: DataFrame, series: DataFrame, points: DataFrame) -> DataFrame:
    """(observation_id, path) of everything that the exchanges export."""
    return mapping.exported_paths(documents, "observation_id", "descriptor").unionByName(value_paths(series, points).select("observation_id", "path"))


def traces(observations: DataFrame, series: DataFrame, points: DataFrame, assertions: DataFrame) -> DataFrame:
    """(observation_id, path, source_kind, source_id) of each path's source:
    made from the evidence alone, without looking at what was exported."""
    described = _gathered(observations, series, assertions).select("observation_id", F.inline(_described()))
    return described.unionByName(_valued(series, points))


def _valued(series: DataFrame, points: DataFrame) -> DataFrame:
    return value_paths(series, points).select("observation_id", "path", F.lit("series").alias("source_kind"), F.col("series_id").cast("string").alias("source_id"))


def _described(paths_only: bool = False) -> Column:
    """The traces of a descriptor's paths, of a row of ``_gathered``."""
    trace = lambda path, kind, source: path if paths_only else F.struct(path.alias("path"), F.lit(kind).alias("source_kind"), source.cast("string").alias("source_id"))
    own = lambda path: trace(F.lit(path), "observation", F.col("observation_id"))
    whole = F.array(*(F.when(F.col("known"), own(p)) for p in ("/name", "/resources/0/name", "/resources/0/path")), F.when(F.col("filename").isNotNull(), own(FILENAME)))
    field = lambda x, parent, k: trace(F.concat(F.lit(f"{parent}/"), x["at"].cast("string"), F.lit(f"/{k}")), "series", x["series_id"])
    named = lambda x, parent: (field(x, parent, "name"), field(x, parent, "type"), F.when(x["unit"].isNotNull(), field(x, parent, "unit")))
    listed = F.flatten(F.transform("s", lambda x: F.array(*named(x, FIELD_LISTS[0]), *named(x, FIELD_LISTS[1]))))
    places = F.create_map(*(F.lit(text) for pair in ASSERTED.items() for text in pair))
    asserted = F.transform(F.filter("said", lambda a: a["value"].isNotNull()), lambda a: trace(places[a["field_name"]], "assertion", a["assertion_id"]))
    return F.filter(F.concat(whole, listed, asserted), lambda t: t.isNotNull())


#: Objects that the descriptor always has: empty, they are leaves of its structure.
STRUCTURE = (f"{_META}/source", f"{_META}/system/electrolyte", f"{_META}/curation", *FIELD_LISTS)


def sides(observations: DataFrame, series: DataFrame, points: DataFrame, assertions: DataFrame, others: DataFrame, lost: Callable[[Column], Column], parts: int) -> DataFrame:
    """(observation_id, path, exported, traced, source_kind, source_id) for
    ``judged``: what the exchanges export and its traces, with those of
    ``others`` and without descriptor paths that are ``lost``.

    A descriptor whose paths are all traced once stays out, if its observation
    has no other traces: paths of values are others than a descriptor's. All
    tables are partitioned by observation_id into ``parts``, and what is made
    of them stays there; Python hides that, so unsound descriptors move again."""
    marked = others.select("observation_id").distinct().withColumn("_marked", F.lit(True))
    stays = lambda path: ~F.coalesce(lost(path), F.lit(False))
    rows = _gathered(observations, series, assertions).join(marked, "observation_id", "left")
    rows = rows.select("observation_id", "known", "filename", "s", "said", "_marked", F.filter(_described(paths_only=True), stays).alias("_traced"), mapping.paths_of(_descriptor()).alias("_paths"))
    paths, traced = F.when(F.col("known"), F.col("_paths")).otherwise(F.array().cast("array<string>")), F.col("_traced")
    sound = F.col("observation_id").isNotNull() & F.col("_marked").isNull() & (F.size(F.array_distinct(traced)) == F.size(traced))
    sound = sound & (F.size(F.array_except(traced, paths)) == 0) & (F.size(F.array_except(paths, F.concat(traced, F.array(*map(F.lit, STRUCTURE))))) == 0)
    unsound = rows.where(~sound).select("observation_id", "known", "filename", "s", "said", paths.alias("_paths")).repartition(parts, "observation_id")
    side = lambda path, exported, traced, kind, source: F.struct(path.alias("path"), F.lit(exported).alias("exported"), F.lit(traced).alias("traced"), kind.alias("source_kind"), source.alias("source_id"))
    none = F.lit(None).cast("string")
    traces = F.filter(_described(), lambda t: stays(t["path"]))
    both = F.concat(F.transform("_paths", lambda p: side(p, True, False, none, none)), F.transform(traces, lambda t: side(t["path"], False, True, t["source_kind"], t["source_id"])))
    values = _valued(series, points).withColumns({"exported": F.lit(True), "traced": F.lit(True)})
    more = others.withColumns({"exported": F.lit(False), "traced": F.lit(True)})
    return unsound.select("observation_id", F.inline(both)).unionByName(values).unionByName(more)


def proof(paths: DataFrame, traced: DataFrame) -> DataFrame:
    """``judged`` of exported paths and their traces."""
    exported = paths.select("observation_id", "path", F.lit(True).alias("exported"), F.lit(False).alias("traced"), *(F.lit(None).cast("string").alias(c) for c in ("source_kind", "source_id")))
    return judged(exported.unionByName(traced.withColumns({"exported": F.lit(False), "traced": F.lit(True)})))


def judged(sides: DataFrame) -> DataFrame:
    """(observation_id, problem, path): ``untraced`` exported paths, traces of
    paths that aren't exported (``not_exported``), and paths with several
    sources (``traced_twice``). A sound exchange gives no row."""
    # both sides meet in one aggregate whose sums have a fixed width; sources are told apart by 128 bits of their hashes
    source = lambda seed: F.when(F.col("traced") & F.col("source_kind").isNotNull() & F.col("source_id").isNotNull(), F.xxhash64(F.lit(seed), "source_kind", "source_id"))
    rows = sides.select("observation_id", "path", F.col("exported").alias("_e"), F.col("traced").alias("_t"), source(1).alias("_h"), source(2).alias("_g"))
    many = (F.min("_h") != F.max("_h")) | (F.min("_g") != F.max("_g"))
    both = rows.groupBy("observation_id", "path").agg(F.max("_e").alias("_exported"), F.max("_t").alias("_traced"), many.alias("_many"))
    problem: Column = F.when(~F.col("_traced") & ~F.col("path").isin(*STRUCTURE), "untraced").when(~F.col("_exported"), "not_exported").when(F.col("_many"), "traced_twice")
    return both.withColumn("problem", problem).where("problem is not null").select("observation_id", "problem", "path")
