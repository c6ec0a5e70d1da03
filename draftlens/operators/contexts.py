"""Nested export operators: flat contexts, validation, null profile, hands."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from draftlens.functions.text import let
from draftlens.functions.values import parse_datetime
from draftlens.sources.schemas import (AUTOTEXT_TYPES, CARD_NAMESPACES, CARD_PRETTY_NAMESPACES, ENTRY_FORMATS, ENTRY_RULES,
                                       HAND, ROLE_PATTERN, STACK_RULES, STORY, TRUTHS, URL_PATTERN, WILD_EXCHANGES)

# The exported columns in order.
CONTEXT_COLUMNS = (
    "suggestion_id", "model_name", "character_name", "character_description", "challenge_name",
    "challenge_text", "challenge_success_description", "challenge_failure_description",
    "played_card_1_name", "played_card_1_description", "previous_entry_text", "suggestion_text",
)
_FACE = T.StructType().add("name", "string").add("description", "string")
# Only what the export reads is parsed.
_ENTRY = (
    T.StructType().add("character_seq_id", "string").add("description", "string")
    .add("target_challenge_card", T.StructType(list(_FACE.fields))
         .add("success_stakes", "string").add("failure_stakes", "string"))
    .add("cards_played_on_challenge", T.ArrayType(_FACE))
)


def _read(contexts: DataFrame, stories: DataFrame | None) -> DataFrame:
    if stories is None:
        rows = contexts.select("suggestion_id", "model_name", F.from_json("story", STORY).alias("s"),
                               F.from_json("generated", _ENTRY).alias("g"))
        last_scene = F.try_element_at("s.scenes", F.lit(-1))
        who = F.get(F.filter("s.characters", lambda c: c["character_seq_id"] == F.col("g.character_seq_id")), 0)
        rows = rows.withColumn("previous", F.try_element_at(last_scene["entries"], F.lit(-1))["description"]).withColumn("who", who)
    else:
        rows = _beside(contexts, stories)
    return rows.select(
        "suggestion_id", "model_name", "g", "previous", "who",
        F.get("g.cards_played_on_challenge", F.lit(0)).alias("card"),
        (F.coalesce(F.size("g.cards_played_on_challenge"), F.lit(0)) > 0).alias("has_cards"),
    )


def _beside(contexts: DataFrame, stories: DataFrame) -> DataFrame:
    """Contexts with what they need of their story: last entry seen and the character.

    A story is read once; its scenes and characters become rows, which are joined by
    game and position, or game and character. Nothing of a story is copied more
    often than it is used.
    """
    told = stories.select("game_pid", F.from_json("story", STORY).alias("s"))
    last = lambda e: F.try_element_at(e, F.lit(-1))["description"]
    scenes = told.select("game_pid", F.posexplode(F.transform("s.scenes", lambda x: last(x["entries"]))).alias("at", "previous"))
    people = told.select("game_pid", F.posexplode("s.characters").alias("nth", "who")).where("who.character_seq_id IS NOT NULL")
    people = people.groupBy("game_pid", F.col("who.character_seq_id").alias("seq")).agg(F.min_by("who", "nth").alias("who"))
    rows = contexts.select("suggestion_id", "model_name", "game_pid", (F.col("position") - 1).alias("at"), F.from_json("generated", _ENTRY).alias("g"))
    rows = rows.join(scenes, ["game_pid", "at"], "left").withColumn("seq", F.col("g.character_seq_id"))
    return rows.join(people, ["game_pid", "seq"], "left")


def context_flatten(contexts: DataFrame, stories: DataFrame | None = None) -> DataFrame:
    """Twelve flat columns per usable context.

    A context has its own ``story`` as it stood, or names ``game_pid`` and
    ``position`` (the number of scenes seen) in ``stories`` (game_pid, story).
    Rows without played cards or without the acting character are left out; a
    missing challenge leaves its columns NULL.
    """
    kept = _read(contexts, stories).where(F.col("has_cards") & F.col("who").isNotNull())
    challenge = "g.target_challenge_card"
    return kept.select(
        "suggestion_id", "model_name", F.col("who.name").alias("character_name"),
        F.col("who.description").alias("character_description"),
        F.col(f"{challenge}.name").alias("challenge_name"),
        F.col(f"{challenge}.description").alias("challenge_text"),
        F.col(f"{challenge}.success_stakes").alias("challenge_success_description"),
        F.col(f"{challenge}.failure_stakes").alias("challenge_failure_description"),
        F.col("card.name").alias("played_card_1_name"),
        F.col("card.description").alias("played_card_1_description"),
        F.coalesce("previous", F.lit("")).alias("previous_entry_text"),
        F.col("g.description").alias("suggestion_text"),
    )


def context_reject_audit(contexts: DataFrame, stories: DataFrame | None = None) -> DataFrame:
    """Contexts that are left out, or that lack a challenge, with the reason."""
    reason = (
        F.when(~F.col("has_cards"), "missing cards")
        .when(F.col("who").isNull(), "missing character")
        .when(F.col("g.target_challenge_card").isNull(), "missing challenge")
    )
    return _read(contexts, stories).select(
        "suggestion_id", "model_name", F.col("g.character_seq_id").alias("character_seq_id"),
        reason.alias("reason"),
        (F.col("has_cards") & F.col("who").isNotNull()).alias("exported"),
    ).where("reason IS NOT NULL")


def _kind(v: Column) -> Column:
    """The type of a JSON value: OBJECT, ARRAY, STRING, BIGINT, DECIMAL, DOUBLE, BOOLEAN or VOID."""
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def _given(v: Column) -> Column:
    return v.isNotNull() & ~F.coalesce(F.is_variant_null(v), F.lit(True))


def _as_text(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


# Texts, numbers and truth values are read as leniently as the service does: a number
# is a text, too, "5" a number, "yes" a truth value.
_NUMBERS = ("BIGINT", "DECIMAL", "DOUBLE", "FLOAT")
_TEXT_KINDS = ("STRING", *_NUMBERS)


def is_text(v: Column) -> Column:
    return _kind(v).isin(*_TEXT_KINDS)


def is_integer(v: Column) -> Column:
    whole = (_kind(v) == "STRING") & F.trim(_as_text(v)).rlike("^[+-]?[0-9]+$")
    return _kind(v).isin(*_NUMBERS, "BOOLEAN") | whole


def is_truth(v: Column) -> Column:
    return (_kind(v) == "BOOLEAN") | (_kind(v).isin("STRING", "BIGINT") & F.lower(_as_text(v)).isin(*TRUTHS))


def is_url(v: Column) -> Column:
    """http or https, a host of dotted labels or an address, an optional port, no white space."""
    return (_kind(v) == "STRING") & _as_text(v).rlike(URL_PATTERN)


def is_url_or_empty(v: Column) -> Column:
    return is_url(v) | ((_kind(v) == "STRING") & (_as_text(v) == ""))


def is_datetime(v: Column) -> Column:
    return (_kind(v).isin(*_NUMBERS)) | ((_kind(v) == "STRING") & parse_datetime(_as_text(v)).isNotNull())


def is_role(v: Column) -> Column:
    return (_kind(v) == "STRING") & _as_text(v).rlike(ROLE_PATTERN)


def one_of(*values: str):
    return lambda v: (_kind(v) == "STRING") & _as_text(v).isin(*values)


LEAVES = {"text": is_text, "int": is_integer, "bool": is_truth, "url": is_url, "url or empty": is_url_or_empty, "datetime": is_datetime, "role": is_role,
          "format": one_of(*ENTRY_FORMATS), "namespace": one_of(*CARD_NAMESPACES), "pretty namespace": one_of(*CARD_PRETTY_NAMESPACES),
          "exchange": one_of(*WILD_EXCHANGES), "autotext type": one_of(*AUTOTEXT_TYPES)}
_FOUND = "array<struct<path:string,leaf:string,needed:boolean,kept:boolean,value:variant>>"


def _found(path: Column, kind: Column, needed: Column, kept: Column, value: Column) -> Column:
    return F.struct(path.alias("path"), kind.alias("leaf"), needed.alias("needed"), kept.alias("kept"), value.alias("value"))


def _kind_of(rule) -> str:
    return rule if isinstance(rule, str) else "list" if isinstance(rule, list) else "object"


def _values(v: Column, rule, path: Column) -> Column:
    """What lies below a JSON value, in the order of the rules: path, expected kind and value.

    ``rule`` is the name of a leaf, a list of one rule, or a dict of fields; a field
    name ends in ``!`` where it must be given, in ``?`` where it may be null but not
    left out. Below a value of another kind than expected lies nothing.
    """
    none = F.array().cast(_FOUND)
    if isinstance(rule, str) and rule != "hand":
        return none
    if not isinstance(rule, dict):
        inner = STACK_RULES if rule == "hand" else rule[0]
        here = lambda i: F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))
        item = lambda x, i: F.concat(F.array(_found(here(i), F.lit(_kind_of(inner)), F.lit(True), F.lit(False), x)), _values(x, inner, here(i)))
        return F.coalesce(F.flatten(F.transform(F.try_variant_get(v, "$", "array<variant>"), item)), none)
    fields = F.when(_kind(v) == "OBJECT", F.try_variant_get(v, "$", "map<string,variant>"))

    def below(m):
        prefix = F.when(path == "", "").otherwise(F.concat(path, F.lit(".")))
        part = lambda r: _found(F.concat(prefix, r["name"]), r["leaf"], r["needed"], r["kept"] & ~F.map_contains_key(m, r["name"]), F.try_element_at(m, r["name"]))
        parts, row = [], []
        for field, inner in [*rule.items(), ("", None)]:
            if inner is not None:
                row.append(f"named_struct('name', '{field.rstrip('!?')}', 'leaf', '{_kind_of(inner)}', 'needed', {field.endswith('!')}, 'kept', {field.endswith('?')})")
            if row and (inner is None or inner not in LEAVES if isinstance(inner, str) else True):
                parts.append(F.transform(F.expr(f"array({', '.join(row)})"), part))  # fields in a row share one expression
                row = []
                if inner is not None:
                    name = field.rstrip("!?")
                    parts.append(_values(F.try_element_at(m, F.lit(name)), inner, F.concat(prefix, F.lit(name))))
        return F.concat(*parts)

    return F.when(fields.isNotNull(), let(fields, below)).otherwise(none)


def faults(v: Column, rule) -> Column:
    """What is wrong with a JSON value, one text for each fault: its path and what it should be.

    All values are listed first, so every kind is tested in one place.
    """
    kinds = {**LEAVES, "object": lambda x: _kind(x) == "OBJECT", "list": lambda x: _kind(x) == "ARRAY",
             "hand": lambda x: (_kind(x) == "ARRAY") | ((_kind(x) == "STRING") & F.startswith(_as_text(x), F.lit("unchanged")))}
    fits = lambda r: reduce(lambda acc, name: acc.when(r["leaf"] == name, kinds[name](r["value"])), kinds, F.when(F.lit(False), F.lit(False)))
    wrong = lambda r: F.when(~_given(r["value"]), F.when(r["needed"] | r["kept"], "missing")).when(~F.coalesce(fits(r), F.lit(False)), r["leaf"])
    top = F.array(_found(F.lit(""), F.lit(_kind_of(rule)), F.lit(True), F.lit(False), v))
    said = F.transform(F.concat(top, _values(v, rule, F.lit(""))), lambda r: let(wrong(r), lambda w: F.when(w.isNotNull(), F.concat(r["path"], F.lit(": "), w))))
    return F.array_compact(said)


def entry_validate(entries: DataFrame, col: str = "entry") -> DataFrame:
    """Each entry with its faults, paths and all, in the order of the schema.

    ``errors`` is empty for a valid entry. Text that is not JSON is ``malformed``,
    null is ``missing``. Types, enumerations, roles, times and URLs are tested at
    any depth: cards in lists, their images, hands, autotexts and their cards.
    """
    v = F.try_parse_json(col)
    found = F.when(F.col(col).isNull(), F.array(F.lit("missing"))).when(v.isNull(), F.array(F.lit("malformed"))).otherwise(faults(v, ENTRY_RULES))
    return entries.withColumn("errors", F.array_join(found, "; "))


def split_valid(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid entries and the quarantined rest."""
    return validated.where("errors = ''").drop("errors"), validated.where("errors <> ''")


# Escapes that stand for \\ and \" while strings are located; the sign that opens them
# is escaped itself, so a text that holds it keeps it.
_SIGN = "\ue000"
_ESCAPES = ((_SIGN, _SIGN + "s"), ("\\\\", _SIGN + "b"), ('\\"', _SIGN + "q"))
_MEANT = ((_SIGN + "q", '"'), (_SIGN + "b", "\\"), (_SIGN + "s", _SIGN))


def null_keys(json: Column) -> Column:
    """The distinct keys, at any depth, whose value is null.

    In compact JSON a null member reads ``"key":null``. With escapes masked,
    every string is one match of the pattern, so text cannot be taken for a key.
    """
    compact = F.to_json(F.try_parse_json(json))
    masked = reduce(lambda t, e: F.replace(t, F.lit(e[0]), F.lit(e[1])), _ESCAPES, compact)
    strings = F.regexp_extract_all(masked, F.lit('"[^"]*"(?::null)?'), F.lit(0))
    members = F.filter(strings, lambda s: F.endswith(s, F.lit('":null')))
    key = lambda s: reduce(lambda t, e: F.replace(t, F.lit(e[0]), F.lit(e[1])), _MEANT, F.regexp_extract(s, '^"([^"]*)"', 1))
    return F.array_distinct(F.transform(members, key))


def null_key_profile(docs: DataFrame, col: str) -> DataFrame:
    """In how many documents each key is null somewhere."""
    return docs.select(F.explode(null_keys(F.col(col))).alias("key")).groupBy("key").agg(
        F.count("*").alias("documents"))


def hand_fill(entries: DataFrame, block: int = 4096) -> DataFrame:
    """Replace ``"unchanged"`` hands by the role's last known hand in the scene.

    Input: game_pid, scene, turn, entry JSON. Output: the hand before and after
    each entry as JSON. A hot (game, scene, role) is cut into blocks of turns:
    hands are filled inside a block, and one row per block carries the last hand
    onward.
    """
    fields = "struct<role:string,hand_context:struct<pre:string,post:string>>"
    e = F.col("e")
    known = lambda side: F.when(e["hand_context"][side] != "unchanged", e["hand_context"][side])
    group = ["game_pid", "scene", "role"]
    read = entries.select("game_pid", "scene", "turn", F.from_json("entry", fields).alias("e"))
    rows = read.select(
        "game_pid", "scene", e["role"].alias("role"), "turn", known("pre").alias("pre"), known("post").alias("post"),
        F.floor(F.col("turn") / block).alias("block"))
    # What the hand is known to be after each entry, if the entry tells.
    rows = rows.withColumn("told", F.coalesce("post", "pre"))
    inside = Window.partitionBy(*group, "block").orderBy("turn")
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.where("told IS NOT NULL").groupBy(*group, "block").agg(F.max_by("told", "turn").alias("told"))
    marks = rows.select(*group, "block").distinct().join(blocks, group + ["block"], "left")
    onward = Window.partitionBy(*group).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = marks.select(*group, "block", F.last("told", ignorenulls=True).over(onward).alias("carried"))
    return (
        rows.withColumn("held", F.last("told", ignorenulls=True).over(earlier))
        .join(carried, group + ["block"])
        .withColumn("pre", F.coalesce("pre", "held", "carried"))
        .select(*group, "turn", F.col("pre").alias("hand_before"), F.coalesce("post", "pre").alias("hand_after"))
    )


def parse_hand(hand: Column) -> Column:
    """A hand as an array of stacks; NULL for ``"unchanged"``."""
    return F.from_json(hand, HAND)


def context_json(contexts: DataFrame) -> DataFrame:
    """Model, story, generated and finalized entry as nested values."""
    return contexts.select("model_name", *[F.try_parse_json(c).alias(c) for c in ("story", "generated", "finalized")])


def write_contexts_csv(contexts: DataFrame, path: str, stories: DataFrame | None = None) -> None:
    """The flat export as CSV: header, fixed column order."""
    context_flatten(contexts, stories).select(*CONTEXT_COLUMNS).write.option("header", True).option(
        "escape", '"').option("lineSep", "\n").csv(path)


def write_contexts_json(contexts: DataFrame, path: str, stories: DataFrame | None = None) -> None:
    """The nested export, one JSON object per line.

    With ``stories``, an object for each story: the story once, and the contexts that
    name it (position, model, generated and finalized entry), which thus meet in one row.
    """
    if stories is None:
        context_json(contexts).write.json(path)
        return
    of = F.struct("suggestion_id", "position", "model_name", *[F.try_parse_json(c).alias(c) for c in ("generated", "finalized")])
    lists = contexts.groupBy("game_pid").agg(F.collect_list(F.to_json(of)).alias("contexts"))
    rows = stories.select("game_pid", F.try_parse_json("story").alias("story")).join(lists, "game_pid")
    rows.select("game_pid", "story", F.transform("contexts", F.parse_json).alias("contexts")).write.json(path)
