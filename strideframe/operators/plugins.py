"""Models that others bring: detectors, pose models, decoders (X-01..X-03, X-08, X-10..X-12, S-12).

None is part of this package. A model is a class that takes frames as pandas
batches; `model` files it under its role and name with the schema of its rows,
which must hold the columns that operators read from that role.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

#: Columns that each role gives for the operators that follow it.
NEEDED = {
    "text mask": ("video", "batch", "text"),
    "person mask": ("video", "batch", "persons"),
    "tracker": ("video", "track", "frame"),
    "pose": ("video", "frame", "joints"),
    "decoder": ("video", "frame", "height", "width", "channels", "pixels"),
}
#: X-03: sizes a person model comes in.
SIZES = ("nano", "small", "medium", "large", "extra_large")


class Filed(NamedTuple):
    model: type
    schema: StructType


MODELS: dict[tuple[str, str], Filed] = {}


def model(role: str, name: str, schema: str) -> Callable[[type], type]:
    """X-01: a class decorator; the schema (DDL) is checked here, not when the job runs."""
    rows = StructType.fromDDL(schema)
    missing = set(NEEDED[role]) - set(rows.names)
    if missing:
        raise ValueError(f"{role} {name!r} lacks {sorted(missing)}")

    def file(kind: type) -> type:
        MODELS[role, name] = Filed(kind, rows)
        return kind

    return file


def names(role: str) -> list[str]:
    return sorted(n for r, n in MODELS if r == role)


def check_size(size: str) -> str:
    if size not in SIZES:
        raise ValueError(size)
    return size


def apply_model(frames: DataFrame, role: str, name: str, **options) -> DataFrame:
    """Rows of a filed model over frames; it is built once in a task, from options, and called batch by batch."""
    if (role, name) not in MODELS:
        raise ValueError(f"no {role} {name!r}; there are {names(role)}")
    kind, schema = MODELS[role, name]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        built = kind(**options)
        for batch in batches:
            yield built(batch)

    return frames.mapInPandas(run, schema)
