"""Open-schema JSON payloads.

A payload is JSON text at rest. It is opened as ``map<string,variant>``, so numbers,
booleans and nested values keep their type through a merge.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

OPEN_MAP = "map<string,variant>"


def parse(payload: str | Column) -> Column:
    """The payload as a map; an empty map when the text is not a JSON object."""
    empty = F.from_json(F.lit("{}"), OPEN_MAP)
    return F.coalesce(open_object(payload), empty)


def serialise(value: str | Column) -> Column:
    return F.coalesce(F.to_json(value), F.lit("{}"))


def open_object(payload: str | Column) -> Column:
    """The payload as a map; null when the text is not a JSON object."""
    return F.from_json(payload, OPEN_MAP)


def is_object(payload: str | Column) -> Column:
    return F.json_object_keys(payload).isNotNull()


def size(opened: Column) -> Column:
    """Number of distinct top-level keys of an opened payload."""
    return F.size(F.array_distinct(F.map_keys(opened)))


def merge(opened: Column, additions: dict[str, Column]) -> Column:
    """JSON text of an opened payload with ``additions`` set, replacing equal keys.

    Needs ``spark.sql.mapKeyDedupPolicy=LAST_WIN`` (see ``session.configure``).
    """
    pairs = [part for key, value in additions.items()
             for part in (F.lit(key), value.cast("variant"))]
    return F.to_json(F.map_concat(opened, F.create_map(*pairs)))
