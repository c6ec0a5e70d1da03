"""Stored domain tables, brought to the shape that the operators expect.

A stored table may have its columns in another order, lack those that follow from
others or have a default, hold more, and use other widths. What cannot be made up
for, or a value that does not fit its type, is an error.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from draftlens.functions.values import iso_text, uuid_norm


class Field:
    """A column: its type, what stands in when it is absent or null, and allowed values.

    ``source`` makes it from columns that must all be there: (names, function).
    """

    def __init__(self, kind: str, default=None, source: tuple[tuple[str, ...], Callable[..., Column]] | None = None,
                 needed: bool = False, values: tuple[str, ...] = (), clean: Callable[[Column], Column] | None = None):
        self.kind, self.default, self.source, self.needed, self.values, self.clean = kind, default, source, needed, values, clean


def _json(column: str, field: str):
    return ((column,), lambda: F.try_variant_get(F.try_parse_json(F.col(column).cast("string")), f"$.{field}", "string"))


def _done() -> Column:
    """A published text: neither null nor the JSON value null."""
    return F.col("finalized").isNotNull() & (F.col("finalized") != "null")


STATUS = ("pending", "executing", "failed", "done")
SCHEMAS: dict[str, dict[str, Field]] = {
    "model": {
        "id": Field("int", needed=True), "name": Field("string", needed=True), "url": Field("string"), "type": Field("string", "scene_entry"),
        "status": Field("string", "inactive", values=("active", "inactive")), "quota": Field("int", -1)},
    "story": {
        "id": Field("bigint", needed=True), "hash": Field("string", needed=True), "game_pid": Field("string", source=_json("story", "game_pid")),
        "exported_at": Field("string", source=_json("story", "exported_at")), "status": Field("string", "pending", values=("pending", "ready", "failed"))},
    "assignment": {"model_id": Field("int", needed=True), "story_hash": Field("string", needed=True)},
    "suggestion": {
        "id": Field("bigint", needed=True), "uuid": Field("string", needed=True, clean=uuid_norm), "story_hash": Field("string", needed=True),
        "context_hash": Field("string"), "type": Field("string", "scene_entry"), "user_pid": Field("string", source=_json("context", "user_pid")),
        "ts": Field("timestamp", source=(("timestamp",), lambda: F.col("timestamp"))),
        "created_at": Field("string", source=(("ts",), lambda: iso_text(F.col("ts").cast("timestamp")))),
        "status": Field("string", "pending", values=STATUS), "is_finalized": Field("boolean", source=(("finalized",), _done)),
        "generated": Field("string"), "finalized": Field("string", clean=lambda c: F.nullif(c, F.lit("null")))},
    "feedback": {
        "suggestion_id": Field("string", needed=True, clean=uuid_norm), "response": Field("string"),
        "type": Field("string", needed=True, values=("fluency", "relevance", "coherence", "likeability", "comments"))},
}


def reconcile(stored: DataFrame, name: str) -> DataFrame:
    """A stored table with the columns of its schema, in their order."""
    out = stored
    lost = []
    for column, field in SCHEMAS[name].items():
        given = column in out.columns
        if not given and field.source and all(c in out.columns for c in field.source[0]):
            out, given = out.withColumn(column, field.source[1]()), True
        if not given and field.needed:
            lost.append(column)
        value = F.col(column) if given else F.lit(None)
        value = value.cast(field.kind)
        if field.clean is not None:
            value = field.clean(value)
        if field.default is not None:
            value = F.coalesce(value, F.lit(field.default).cast(field.kind))
        if field.values:
            listed = ", ".join(field.values)
            value = F.when(value.isNull() | value.isin(*field.values), value).otherwise(
                F.raise_error(F.concat(F.lit(f"{name}.{column} is not one of {listed}: "), value)))
        out = out.withColumn(column, value)
    if lost:
        raise ValueError(f"stored table {name} lacks {', '.join(lost)}")
    return out.select(*SCHEMAS[name])
