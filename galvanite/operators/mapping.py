"""Exchange mappings: which exported paths come from which fields."""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def leaves(value: object, path: str = "") -> Iterator[str]:
    """Paths of a JSON value's leaves; an empty object or list is one."""
    parts = value.items() if isinstance(value, dict) else enumerate(value) if isinstance(value, list) else ()
    inner = list(parts)
    if not inner:
        yield path
    for name, child in inner:
        yield from leaves(child, f"{path}/{name}")


#: Shapes of documents whose paths a task keeps.
_SHAPES = 10_000


def _shape(body: str) -> tuple[str, str] | None:
    """A JSON text without the strings that are no keys: what is between the
    strings, and the keys. None if strings may hold what must be looked at."""
    if "\\" in body or not body.isprintable():
        return None
    parts = body.split('"')
    if len(parts) % 2 == 0:  # a quote without its fellow
        return None
    keys = [s for s, after in zip(parts[1::2], parts[2::2], strict=True) if after.lstrip().startswith(":")]
    return '"'.join(parts[::2]), '"'.join(keys)


def paths_of(text: Column) -> Column:
    """The paths of every leaf of a JSON document as an array, once each;
    ``!`` for a text that is no JSON. Documents that differ only in their
    strings have the same paths, which a task lists once."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        shapes: dict[tuple[str, str], pa.Array] = {}
        none = pa.array(["!"], pa.string())
        for batch in batches:
            listed = []
            for body in batch.to_pylist():
                try:
                    shape = _shape(body)
                    found = shapes.get(shape)
                    if found is None:
                        found = pa.array(sorted(set(leaves(json.loads(body)))), pa.string())
                        if shape:
                            if len(shapes) >= _SHAPES:
                                shapes.clear()
                            shapes[shape] = found
                except (TypeError, ValueError):
                    found = none
                listed.append(found)
            ends = pa.array([0, *accumulate(map(len, listed))], pa.int32())
            yield pa.ListArray.from_arrays(ends, pa.concat_arrays(listed or [none]))

    return F.arrow_udf(run, "array<string>").asNondeterministic()(text)  # so that no filter repeats it


def exported_paths(documents: DataFrame, key: str, text: str) -> DataFrame:
    """(key, path) for every leaf of every JSON document, as ``paths_of``."""
    return documents.select(key, paths_of(F.col(text)).alias("paths")).select(key, F.explode("paths").alias("path"))


def mapping_problems(entries: DataFrame, required: DataFrame, key: str) -> DataFrame:
    """(key, problem, path): fields that are classified twice, external paths
    that several fields claim, and required fields that none classifies.
    ``entries`` has (key, field, external), ``required`` (key, field)."""
    twice = entries.groupBy(key, "field").agg(F.count("*").alias("n")).where("n > 1").select(key, F.lit("duplicate").alias("problem"), F.col("field").alias("path"))
    shared = entries.where("external is not null").groupBy(key, "external").agg(F.count("*").alias("n")).where("n > 1").select(key, F.lit("collision").alias("problem"), F.col("external").alias("path"))
    missing = required.select(key, "field").distinct().join(entries.select(key, "field"), [key, "field"], "left_anti").select(key, F.lit("incomplete").alias("problem"), F.col("field").alias("path"))
    return twice.unionByName(shared).unionByName(missing)


def untraced(paths: DataFrame, entries: DataFrame, key: str) -> DataFrame:
    """(key, path): exported paths that no mapping entry accounts for."""
    return paths.select(key, "path").distinct().join(entries.select(key, F.col("external").alias("path")), [key, "path"], "left_anti")
