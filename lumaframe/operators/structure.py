"""The model's rules on raw JSON: values that aren't objects or lists where the typed tables would need them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

#: What each code says. The codes.
MESSAGES = {
    "invalid_project": "a project must be an object", "invalid_frames": "a project needs a frame", "invalid_frame": "a frame must be an object", "invalid_frame_tags": "frame tags must be a list",
    "invalid_frame_tag": "a frame tag must be an object", "invalid_layers": "a project needs a layer", "invalid_layer": "a layer must be an object", "invalid_cels": "a layer needs a list of cels",
    "invalid_cel": "a cel must be an object",
}


def _is(value: Column, *kinds: str) -> Column:
    kind = F.schema_of_variant(value)
    holds = F.lit(False)
    for k in kinds:
        holds = holds | kind.startswith(k)
    return F.coalesce(holds, F.lit(False))


def _record(value: Column) -> Column:
    """Whether a value has fields: objects, and lists too, whose named fields are all absent."""
    return _is(value, "OBJECT", "ARRAY")


def _items(value: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(value, F.lit(path), "array<variant>"), F.array().cast("array<variant>"))


def _at(code: str, path: Column) -> Column:
    return F.struct(F.lit(code).alias("code"), path.alias("path"))


def _each(items: Column, rule: Callable[[Column, Column], Column]) -> Column:
    """rule(item, place as text) gives an array of violations for each item; here they stand in one, in order."""
    return F.flatten(F.transform(items, lambda x, i: rule(x, i.cast("string"))))


def _when(condition: Column, code: str, path: Column) -> Column:
    return F.when(condition, F.array(_at(code, path))).otherwise(F.array().cast("array<struct<code:string,path:string>>"))


def structure_violations(rows: DataFrame, id_col: str = "project_id", json_col: str = "json") -> DataFrame:
    """project_id, code, path, message, ordinal (from 1): the violations of each JSON text, in document order, whatever it holds.

    A row's violations come of that row alone, without a shuffle; rows that repeat are judged each. A null or empty text, one that is no
    JSON, one that names a field of an object twice and one beyond a variant's size are no project. Nothing is looked for below
    what is no object, nor past an absent or empty list of layers; absent frame tags are none. Other columns, whatever their names, are left out."""
    variant = rows.select(F.col(id_col).alias("project_id"), F.try_parse_json(json_col).alias("v"))
    v, part = F.col("v"), lambda name: F.try_variant_get("v", F.lit(f"$.{name}"), "variant")
    path = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    member = lambda name, code: _each(_items(v, f"$.{name}"), lambda x, i: _when(~_record(x), code, path(f"{name}[", i, "]")))

    def layer(x: Column, i: Column) -> Column:
        here = path("layers[", i, "]")
        cels = _each(_items(x, "$.cels"), lambda c, j: _when(~_record(c), "invalid_cel", path(here, ".cels[", j, "]")))
        no_list = ~_is(F.try_variant_get(x, F.lit("$.cels"), "variant"), "ARRAY")
        return F.when(~_record(x), F.array(_at("invalid_layer", here))).otherwise(F.concat(_when(no_list, "invalid_cels", path(here, ".cels")), cels))

    tags = part("frameTags")
    found = F.concat(
        _when(F.size(_items(v, "$.frames")) == 0, "invalid_frames", path("frames")), member("frames", "invalid_frame"),
        _when(tags.isNotNull() & ~_is(tags, "ARRAY"), "invalid_frame_tags", path("frameTags")), member("frameTags", "invalid_frame_tag"),
        _when(F.size(_items(v, "$.layers")) == 0, "invalid_layers", path("layers")), _each(_items(v, "$.layers"), layer),
    )
    found = F.when(_record(v), found).otherwise(F.array(_at("invalid_project", path("project"))))
    out = variant.select("project_id", F.posexplode(found).alias("place", "found"))
    message = F.element_at(F.create_map(*[F.lit(x) for p in MESSAGES.items() for x in p]), F.col("found.code"))
    return out.select("project_id", "found.code", "found.path", message.alias("message"), (F.col("place") + 1).alias("ordinal"))
