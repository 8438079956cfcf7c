"""A decoded document in memory, between a source's bytes and the model's tables."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


class SourceError(ValueError):
    """A source that can't be imported: a code, and a message that this package wrote itself."""

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


def need(holds: object, code: str, message: str) -> None:
    if not holds:
        raise SourceError(code, message)


@dataclass
class Cel:
    frame: int
    pixels: np.ndarray  # height x width x 4 bytes
    x: int = 0
    y: int = 0


@dataclass
class Layer:
    id: str
    name: str
    visible: bool = True
    opacity: int = 255
    cels: list[Cel] = field(default_factory=list)


@dataclass
class Tag:
    name: str
    first: int
    last: int
    direction: str


@dataclass
class Document:
    width: int
    height: int
    durations: list[int]
    layers: list[Layer]
    tags: list[Tag] = field(default_factory=list)


def clamp_duration(ms: float) -> int:
    return int(max(1, min(65535, np.floor(ms + 0.5))))


def opacity_byte(share: float) -> int:
    return int(np.floor(share * 255 + 0.5))


def main_layer(width: int, height: int, durations: list[int], images: list[np.ndarray], layer_id: str = "main", name: str = "Main", tags: list[Tag] | None = None) -> Document:
    """A document of one layer whose cels cover the canvas."""
    return Document(width, height, durations, [Layer(layer_id, name, cels=[Cel(i, x) for i, x in enumerate(images)])], tags or [])
