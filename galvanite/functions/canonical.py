"""Content-derived identities.

A value's canonical bytes are compact JSON with sorted keys in UTF-8, text in
NFC, decimals as plain digits with all their zeros. Floats, bytes, keys other
than text and naive times are refused: their text isn't unique."""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Mapping
from datetime import UTC, date, datetime
from decimal import Decimal
from enum import Enum
from uuid import UUID

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def plain(value: object) -> object:
    """The JSON form of a value, or TypeError or ValueError."""
    match value:
        case Enum():
            return plain(value.value)
        case None | bool() | int():
            return value
        case str():
            return unicodedata.normalize("NFC", value)
        case Decimal():
            if not value.is_finite():
                raise ValueError("a decimal must be finite")
            return format(value, "f")
        case datetime():
            if value.tzinfo is None:
                raise ValueError("a time must have a zone")
            return value.astimezone(UTC).isoformat()
        case date():
            return value.isoformat()
        case UUID():
            return str(value)
        case Mapping():
            if not all(isinstance(k, str) for k in value):
                raise TypeError("keys must be text")
            return {unicodedata.normalize("NFC", k): plain(v) for k, v in value.items()}
        case set() | frozenset():
            return sorted((plain(x) for x in value), key=lambda x: json.dumps(x, sort_keys=True))
        case list() | tuple():
            return [plain(x) for x in value]
    raise TypeError(f"{type(value).__name__} has no canonical form")


def canonical_bytes(value: object) -> bytes:
    return json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()


def content_id(kind: str, value: object) -> str:
    """kind and the first 32 hex digits of the SHA-256 of the canonical bytes."""
    return f"{kind}:{hashlib.sha256(canonical_bytes(value)).hexdigest()[:32]}"


def flat_content_id(kind: str, **columns: Column) -> Column:
    """The same for a flat record of text, integers and booleans, natively:
    fields in alphabetical order, nulls kept. Text must be NFC already."""
    record = F.struct(*(columns[k].alias(k) for k in sorted(columns)))
    body = F.to_json(record, {"ignoreNullFields": "false"})
    return F.concat(F.lit(f"{kind}:"), F.substring(F.sha2(body, 256), 1, 32))


def nested_content_id(kind: str):
    """A column function from JSON text (numbers as text) to identities, for
    nested records; Arrow batches, as NFC and sorted keys need Python."""

    @F.pandas_udf("string")
    def identify(text: pd.Series) -> pd.Series:
        return text.map(lambda t: None if t is None else content_id(kind, json.loads(t, parse_float=Decimal)))

    return identify


#: JSON that Spark itself writes as ``canonical_bytes`` does: characters below U+0300 (all of them NFC, none a
#: control character), no character escaped by its number, and only whole numbers of at most 37 digits.
_OTHER_TEXT, _OTHER_NUMBER, _STRINGS = r"[^\x20-˿]|\\u", r"[0-9][.eE]|[0-9]{38}", r'"(?:[^"\\]|\\.)*+"'


def with_content_id(rows: DataFrame, text: str, kind: str, name: str = "content_id") -> DataFrame:
    """The rows with ``name``, the identity of the nested record in the JSON
    column ``text``, as ``content_id`` gives it. Null stays null, and text that
    is no JSON gives null.

    Almost all records are put in order by a VARIANT, whose objects keep their
    keys sorted, and hashed without Python. Only rows with other characters,
    fractions or repeated keys go to an Arrow function."""
    parsed = F.to_json(F.try_parse_json(text))
    numbers = F.regexp_replace(text, F.lit(_STRINGS), F.lit('""'))
    native = F.col(text).isNull() | (parsed.isNotNull() & ~F.col(text).rlike(_OTHER_TEXT) & ~numbers.rlike(_OTHER_NUMBER))
    own = F.concat(F.lit(f"{kind}:"), F.substring(F.sha2(parsed, 256), 1, 32))
    plain_rows = rows.where(native).withColumn(name, own)
    return plain_rows.unionByName(rows.where(~native).withColumn(name, _lenient_content_id(kind)(F.col(text))))


def _lenient_content_id(kind: str):
    def one(text: str | None) -> str | None:
        try:
            return content_id(kind, json.loads(text, parse_float=Decimal, parse_constant=_refused))
        except (ValueError, TypeError):
            return None

    @F.pandas_udf("string")
    def identify(text: pd.Series) -> pd.Series:
        return text.map(one)

    return identify


def _refused(name: str) -> None:
    raise ValueError(f"{name} is no JSON")
