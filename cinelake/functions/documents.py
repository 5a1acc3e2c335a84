"""Tolerant reading of semi-structured text, and the texts built from templates."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _variant(raw: Column) -> Column:
    return F.try_parse_json(raw)


def json_items(raw: Column) -> Column:
    """Elements of a JSON array as `array<variant>`; empty for null, broken text and non-arrays."""
    items = F.try_variant_get(_variant(raw), "$", "array<variant>")
    return F.coalesce(items, F.expr("cast(array() as array<variant>)"))


def json_is_array(raw: Column) -> Column:
    return F.coalesce(F.schema_of_variant(_variant(raw)).startswith("ARRAY"), F.lit(False))


def json_is_object(raw: Column) -> Column:
    return F.coalesce(F.schema_of_variant(_variant(raw)).startswith("OBJECT"), F.lit(False))


def json_strings(raw: Column) -> Column:
    """A JSON array read as strings, nulls dropped."""
    texts = F.transform(json_items(raw), lambda item: F.try_variant_get(item, "$", "string"))
    return F.filter(texts, lambda t: t.isNotNull())


def json_objects(raw: Column, fields: dict[str, str], required: tuple[str, ...] = (), absent: dict[str, str] | None = None) -> Column:
    """A JSON array read as structs. Elements that are no objects, or lack a required field, are dropped.

    `absent` gives values for fields an object does not have; a field that is there and null stays null.
    """

    def value(item: Column, name: str, kind: str) -> Column:
        got = F.try_variant_get(item, f"$.{name}", kind)
        if name not in (absent or {}):
            return got
        there = F.map_contains_key(F.try_variant_get(item, "$", "map<string,variant>"), name)
        return F.when(there, got).otherwise(F.lit(absent[name]).cast(kind))

    def read(item: Column) -> Column:
        return F.struct(*[value(item, n, t).alias(n) for n, t in fields.items()])

    def keep(item: Column) -> Column:
        ok = F.schema_of_variant(item).startswith("OBJECT")
        for name in required:
            ok = ok & F.try_variant_get(item, f"$.{name}", "variant").isNotNull()
        return F.coalesce(ok, F.lit(False))

    return F.transform(F.filter(json_items(raw), keep), read)


def json_field(raw: Column, path: str, dtype: str = "string") -> Column:
    """One field of a JSON document; null when the text or the value does not fit."""
    return F.try_variant_get(_variant(raw), path, dtype)


def fenced_json(text: Column) -> Column:
    """Body of the first ```json fence, else of the first fence, else the whole text, trimmed."""
    tagged = F.instr(text, "```json") > 0
    plain = F.instr(text, "```") > 0
    after_tag = F.get(F.split(text, "```json", 2), F.lit(1))
    after_fence = F.get(F.split(text, "```", 2), F.lit(1))
    body = F.when(tagged, F.get(F.split(after_tag, "```", 2), F.lit(0))).when(
        plain, F.get(F.split(after_fence, "```", 2), F.lit(0))
    )
    return F.regexp_replace(F.coalesce(body, text), r"^\s+|\s+$", "")


def canonical_hash(document: Column) -> Column:
    """SHA-256 of a struct's JSON. Stable as long as the struct's field order is."""
    return F.sha2(F.to_json(document), 256)


def fill_template(template: str, values: dict[str, Column]) -> Column:
    """Replace each `{name}` by its value, in the order given."""
    out: Column = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return out


def flat_event(event_type: Column, stage: Column, job_id: Column, payload: Column) -> Column:
    """Event fields merged with the payload's, as `map<string,string>` of JSON values; the payload's win.

    A payload that is no JSON object is kept as text under `payload_json`.
    """

    def quoted(c: Column) -> Column:
        # JSON of a bare string: the member of a one-field object, without the braces and the name.
        return F.when(c.isNull(), F.lit("null")).otherwise(
            F.regexp_extract(F.to_json(F.struct(c.alias("v"))), r'^\{"v":(.*)\}$', 1)
        )

    base = F.map_from_arrays(
        F.array(F.lit("event_type"), F.lit("stage"), F.lit("job_id")),
        F.array(quoted(event_type), quoted(stage), quoted(job_id)),
    )
    parsed = F.transform_values(
        F.try_variant_get(_variant(payload), "$", "map<string,variant>"), lambda _k, v: F.to_json(v)
    )
    broken = F.map_from_arrays(F.array(F.lit("payload_json")), F.array(quoted(payload)))
    extra = F.when(payload.isNull() | (payload == ""), F.expr("cast(map() as map<string,string>)")).otherwise(
        F.coalesce(parsed, broken)
    )
    kept = F.map_filter(base, lambda k, _v: ~F.map_contains_key(extra, k))
    return F.map_concat(kept, extra)


def flat_event_json(event_type: Column, stage: Column, job_id: Column, payload: Column) -> Column:
    """`flat_event` as JSON text with the keys in order."""
    entries = F.array_sort(F.map_entries(flat_event(event_type, stage, job_id, payload)))
    members = F.transform(entries, lambda e: F.concat(F.lit('"'), e["key"], F.lit('":'), e["value"]))
    return F.concat(F.lit("{"), F.array_join(members, ","), F.lit("}"))
