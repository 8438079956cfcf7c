"""Ordered compositing: one canvas per project, drawn frame by frame, a snapshot before each frame is disposed of."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..shipping import ship_code
from ..sources.animated import Frame, compose

SNAPSHOTS = "project_id string, frame_index int, w int, h int, rgba binary"
_SCHEMA = pa.schema([("project_id", pa.string()), ("frame_index", pa.int32()), ("w", pa.int32()), ("h", pa.int32()), ("rgba", pa.binary())])


def composite(frames: DataFrame) -> DataFrame:
    """project_id, frame_index, w, h, rgba: what each frame shows.

    frames: project_id, width, height (of the canvas), frame_index, left, top, w, h, rgba, dispose (keep, clear, background,
    previous), blend (true: straight alpha over; false: replace), and background (a colour as 4 bytes, used by that
    disposal; null: transparent). With blend false, pixels of alpha 0 replace like any other."""

    ship_code(frames.sparkSession)
    names = ("project_id", "width", "height", "frame_index", "left", "top", "w", "h", "rgba", "dispose", "blend", "background")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            for k in range(0, b.num_rows, 64):
                yield from b.slice(k, 64).to_pylist()

    def drawn(project: Iterator[dict], shown: list[int]) -> Iterator[tuple[Frame, np.ndarray, None]]:
        for r in project:
            back = tuple(r["background"]) if r["background"] else (0, 0, 0, 0)
            shown.append(r["frame_index"])
            yield Frame(r["left"], r["top"], r["w"], r["h"], 0, r["dispose"], r["blend"], back), np.frombuffer(r["rgba"], np.uint8).reshape(r["h"], r["w"], 4), None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some, size = [], 0
        for key, project in groupby(rows(batches), key=lambda r: r["project_id"]):
            first, shown = next(project), []
            width, height = first["width"], first["height"]
            for canvas in compose(width, height, drawn(chain([first], project), shown)):
                some.append({"project_id": key, "frame_index": shown[-1], "w": width, "h": height, "rgba": canvas.tobytes()})
                size += canvas.nbytes + 100
                if size > 4 << 20:
                    yield pa.RecordBatch.from_pylist(some, _SCHEMA)
                    some, size = [], 0
        if some:
            yield pa.RecordBatch.from_pylist(some, _SCHEMA)

    # a project's frames come one after another in one task, which holds one canvas and the snapshots it has not handed on
    return frames.select(*names).repartition("project_id").sortWithinPartitions("project_id", "frame_index").mapInArrow(run, SNAPSHOTS)
