"""The model's integrity rules: violations as rows, in document order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalars import valid_direction, valid_duration, valid_name


def inside(x: str, y: str, w: str, h: str, width: Column, height: Column) -> Column:
    """Whether a rectangle has an area and lies within a canvas."""
    x, y, w, h = map(F.col, (x, y, w, h))
    return (w > 0) & (h > 0) & (x >= 0) & (y >= 0) & (x + w <= width) & (y + h <= height)


def bound_codes(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """The codes of a cel's position, axis by axis."""
    codes = [F.when(x < 0, "invalid_cel_x"), F.when(y < 0, "invalid_cel_y"), F.when((x >= 0) & (x + w > width), "cel_out_of_bounds"), F.when((y >= 0) & (y + h > height), "cel_out_of_bounds")]
    return F.filter(F.array(*codes), lambda c: c.isNotNull())


def ordered(rows: DataFrame, rules: list[tuple[str, Column]], key: list[str], order: str) -> DataFrame:
    """A row for each rule that holds for a row: its code, and its place (from 1) within the key, by rule and then row."""
    codes = F.filter(F.array(*[F.when(c, F.struct(F.lit(k).alias("section"), F.lit(code).alias("code"))) for k, (code, c) in enumerate(rules)]), lambda v: v.isNotNull())
    rows = rows.select(*key, order, F.explode(codes).alias("v")).select(*key, order, "v.*")
    return rows.withColumn("ordinal", F.row_number().over(Window.partitionBy(*key).orderBy("section", order)))


#: What each code says. The codes.
MESSAGES = {
    "invalid_width": "the width must be a positive whole number", "invalid_height": "the height must be a positive whole number", "invalid_color_mode": "the colour mode must be rgba",
    "invalid_frames": "a project needs a frame", "invalid_frame_index": "frame indexes must count from 0 without a gap", "invalid_frame_duration": "a duration must be a whole number from 1 to 65535",
    "invalid_frame_tag_name": "a tag needs a name", "duplicate_frame_tag_name": "two tags have one name", "invalid_frame_tag_from": "a tag must start at a frame index",
    "invalid_frame_tag_to": "a tag must end at a frame index", "invalid_frame_tag_reference": "a tag must refer to frames that exist", "invalid_frame_tag_range": "a tag must not end before it starts",
    "invalid_frame_tag_direction": "a tag's direction must be forward, reverse or ping-pong", "invalid_layers": "a project needs a layer", "invalid_layer_id": "a layer needs an id",
    "duplicate_layer_id": "two layers have one id", "invalid_layer_name": "a layer needs a name", "invalid_layer_visibility": "a layer is visible or not", "invalid_layer_opacity": "an opacity must be from 0 to 255",
    "invalid_cel_frame_reference": "a cel must refer to a frame that exists", "duplicate_cel_frame": "a layer has two cels in one frame", "invalid_cel_image_data": "a cel needs width x height x 4 bytes of pixels",
    "invalid_cel_x": "a cel's x must not be negative", "invalid_cel_y": "a cel's y must not be negative", "cel_out_of_bounds": "a cel reaches beyond the canvas",
}


def _found(rows: DataFrame, section: int, place: list[str], rules: list[tuple[Column, str, Column]]) -> DataFrame:
    """rules: (condition, code, path). place: the columns (two at most) that order rows within the section."""
    struct = [F.when(c, F.struct(F.lit(k).alias("rule"), F.lit(code).alias("code"), p.alias("path"))) for k, (c, code, p) in enumerate(rules)]
    first, second = [F.col(x).cast("int") if x else F.lit(0) for x in [*place, None, None][:2]]
    rows = rows.select("project_id", F.lit(section).alias("section"), first.alias("first"), second.alias("second"), F.explode(F.filter(F.array(*struct), lambda v: v.isNotNull())).alias("v"))
    return rows.select("project_id", "section", "first", "second", "v.*")


def violations(tables: dict[str, DataFrame]) -> DataFrame:
    """project_id, code, path, message, ordinal: every violation of each project, in document order.

    Pixels are not read but for their length. Nothing is found below a project that has no layer at all, past that."""
    projects, frames, tags, layers, cels = (tables[n] for n in ("projects", "frames", "frame_tags", "layers", "cels"))
    by = Window.partitionBy("project_id")
    no = lambda c: F.coalesce(~c, F.lit(True))
    at = lambda form, *c: F.format_string(form, *c)
    frames = frames.withColumn("place", F.row_number().over(by.orderBy("frame_index")) - 1)
    known = frames.where("frame_index = place").select("project_id", "frame_index")
    has = lambda t, name: t.select("project_id").distinct().withColumn(name, F.lit(True))
    projects_ = projects.join(has(frames, "has_frames"), "project_id", "left").join(has(layers, "has_layers"), "project_id", "left")
    lit = F.lit
    head = _found(projects_, 0, [], [
        (no(F.col("width") > 0), "invalid_width", lit("width")), (no(F.col("height") > 0), "invalid_height", lit("height")),
        (no(F.col("color_mode") == "rgba"), "invalid_color_mode", lit("colorMode")), (F.col("has_frames").isNull(), "invalid_frames", lit("frames")),
    ])
    no_layers = _found(projects_, 3, [], [(F.col("has_layers").isNull(), "invalid_layers", lit("layers"))])
    path = at("frames[%d]", "place")
    timing = _found(frames, 1, ["place"], [
        (no(F.col("frame_index") == F.col("place")), "invalid_frame_index", F.concat(path, lit(".index"))),
        (no(valid_duration(F.col("duration_ms"))), "invalid_frame_duration", F.concat(path, lit(".durationMs"))),
    ])
    ends = {}
    for c in ("from_frame", "to_frame"):
        tags = tags.join(known.select("project_id", F.col("frame_index").alias(c), lit(True).alias(f"has_{c}")), ["project_id", c], "left")
        ends[c] = F.coalesce(F.col(c) >= 0, lit(False))
    tags = tags.withColumn("named", F.when(valid_name(F.col("name")), F.row_number().over(Window.partitionBy("project_id", "name").orderBy("tag_index"))))
    path = at("frameTags[%d]", "tag_index")
    tagging = _found(tags, 2, ["tag_index"], [
        (F.col("named").isNull(), "invalid_frame_tag_name", F.concat(path, lit(".name"))), (F.col("named") > 1, "duplicate_frame_tag_name", F.concat(path, lit(".name"))),
        (~ends["from_frame"], "invalid_frame_tag_from", F.concat(path, lit(".from"))), (ends["from_frame"] & F.col("has_from_frame").isNull(), "invalid_frame_tag_reference", F.concat(path, lit(".from"))),
        (~ends["to_frame"], "invalid_frame_tag_to", F.concat(path, lit(".to"))), (ends["to_frame"] & F.col("has_to_frame").isNull(), "invalid_frame_tag_reference", F.concat(path, lit(".to"))),
        (ends["from_frame"] & ends["to_frame"] & (F.col("from_frame") > F.col("to_frame")), "invalid_frame_tag_range", path),
        (no(valid_direction(F.col("direction"))), "invalid_frame_tag_direction", F.concat(path, lit(".direction"))),
    ])
    ids = F.when(valid_name(F.col("layer_id")), F.row_number().over(Window.partitionBy("project_id", "layer_id").orderBy("layer_index")))
    path = at("layers[%d]", "layer_index")
    layering = _found(layers.withColumn("held", ids).withColumn("none", lit(-1)), 4, ["layer_index", "none"], [
        (F.col("held").isNull(), "invalid_layer_id", F.concat(path, lit(".id"))), (F.col("held") > 1, "duplicate_layer_id", F.concat(path, lit(".id"))),
        (~valid_name(F.col("name")), "invalid_layer_name", F.concat(path, lit(".name"))), (F.col("visible").isNull(), "invalid_layer_visibility", F.concat(path, lit(".visible"))),
        (no(F.col("opacity").between(0, 255)), "invalid_layer_opacity", F.concat(path, lit(".opacity"))),
    ])
    image = F.coalesce((F.col("w") > 0) & (F.col("h") > 0) & F.col("color_space").isin("srgb", "display-p3") & (F.octet_length("rgba") == F.col("w").cast("long") * F.col("h") * 4), lit(False))
    cels = cels.select("project_id", "layer_index", "frame_index", "x", "y", "w", "h", image.alias("image"))
    cels = cels.withColumn("place", F.row_number().over(Window.partitionBy("project_id", "layer_index").orderBy("frame_index")) - 1)
    cels = cels.join(known.withColumn("known", lit(True)), ["project_id", "frame_index"], "left").join(projects.select("project_id", "width", "height"), "project_id", "left")
    again = F.row_number().over(Window.partitionBy("project_id", "layer_index", "frame_index").orderBy("place")) > 1
    path = at("layers[%d].cels[%d]", "layer_index", "place")
    out = lambda p, size, edge: (F.col(edge) > 0) & F.col("image") & (F.col(p) >= 0) & (F.col(p) + F.col(size) > F.col(edge))
    celling = _found(cels.withColumn("again", again), 4, ["layer_index", "place"], [
        (F.col("known").isNull(), "invalid_cel_frame_reference", F.concat(path, lit(".frameIndex"))), (F.col("known") & F.col("again"), "duplicate_cel_frame", F.concat(path, lit(".frameIndex"))),
        (~F.col("image"), "invalid_cel_image_data", F.concat(path, lit(".imageData"))), (no(F.col("x") >= 0), "invalid_cel_x", F.concat(path, lit(".x"))), (no(F.col("y") >= 0), "invalid_cel_y", F.concat(path, lit(".y"))),
        (out("x", "w", "width"), "cel_out_of_bounds", F.concat(path, lit(".x"))), (out("y", "h", "height"), "cel_out_of_bounds", F.concat(path, lit(".y"))),
    ])
    rows = reduce(DataFrame.unionByName, [head, timing, tagging, no_layers, layering, celling])
    message = F.element_at(F.create_map(*[lit(x) for p in MESSAGES.items() for x in p]), F.col("code"))
    return rows.select("project_id", "code", "path", message.alias("message"), F.row_number().over(by.orderBy("section", "first", "second", "rule")).alias("ordinal"))


def valid_projects(tables: dict[str, DataFrame]) -> DataFrame:
    """project_id of the projects without a violation."""
    return tables["projects"].select("project_id").join(violations(tables), "project_id", "left_anti")
