"""Frames to registered pairs (S-14, A-11 on images, X-04, V-17..V-19, V-22).

frames: key (video), frame (0, 1, ... without gaps), height, width, channels,
pixels (bytes, row by row, channels last). A batch of frames is averaged in
two steps: each partition adds up what it holds of a batch, and only sums go
through the exchange. The sums of a stretch of SPAN pairs then meet in order
in one stream of Arrow batches, where they are added, cut to whole numbers,
resized, masked, made gray and registered; one image and one spectrum are
carried on from batch to batch.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .registration import blend, window, wrap

#: Pairs of a video that one task registers; pixels of the images that are transformed at a time.
SPAN, PIXELS = 64, 1 << 21


def resampling(size: int, wanted: int, area: bool = False) -> np.ndarray:
    """Weights (wanted, size) of one axis: linear between pixel centres, or means over the pixels' shares where the axis shrinks."""
    out = np.zeros((wanted, size))
    if area and wanted < size:
        edges = np.arange(wanted + 1) * size / wanted
        every = np.arange(size)
        share = np.minimum(edges[1:, None], every + 1) - np.maximum(edges[:-1, None], every)
        return np.clip(share, 0, None) * wanted / size
    centre = np.clip((np.arange(wanted) + 0.5) * size / wanted - 0.5, 0, size - 1)
    low = np.floor(centre).astype(int)
    high = np.minimum(low + 1, size - 1)
    np.add.at(out, (np.arange(wanted), low), 1 - (centre - low))
    np.add.at(out, (np.arange(wanted), high), centre - low)
    return out


def resized(image: np.ndarray, height: int, width: int, area: bool = False) -> np.ndarray:
    """image (height, width) or (height, width, channels) in another size."""
    if image.shape[:2] == (height, width):
        return image
    rows, columns = resampling(image.shape[0], height, area), resampling(image.shape[1], width, area)
    return np.tensordot(rows, np.tensordot(columns, image, (1, 1)), (1, 1)) if image.ndim == 2 else np.einsum("ij,jkc,lk->ilc", rows, image, columns, optimize=True)


def scaled(height: int, width: int, most: int | None) -> tuple[int, int]:
    """F-22: the size whose longer side is `most`; None keeps the size."""
    if most is None:
        return height, width
    k = most / max(height, width)
    return int(height * k + 0.5), int(width * k + 0.5)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows of Arrow batches as dictionaries; bytes stay where they are."""
    for batch in batches:
        columns = [c if pa.types.is_binary(f.type) else c.to_pylist() for f, c in zip(batch.schema, batch.columns, strict=True)]
        for values in zip(*columns, strict=True):
            yield dict(zip(batch.schema.names, values, strict=True))


def _gathered(rows: Iterator[list], schema: pa.Schema, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Arrow batches of rows, of about `most` bytes where the last value is bytes."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 64 + (len(row[-1]) if isinstance(row[-1], bytes) else 0)
        if size > most:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _runs(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[list[dict]]:
    """Consecutive rows that agree in the named columns."""
    for _, rows in itertools.groupby(_rows(batches), key=lambda r: [r[x] for x in names]):
        yield list(rows)


SHAPE = ("height", "width", "channels")


def batch_sums(frames: DataFrame, size: int = 20, key: str = "video") -> DataFrame:
    """Partial sums of batches of `size` frames: key, batch, height, width, channels, n, sums (32-bit numbers).

    A batch has one row for each run of its frames within a partition. Frames of one batch that differ in shape are an error.
    """
    lean = frames.select(key, F.floor(F.col("frame") / size).cast("long").alias("batch"), *(F.col(x).cast("int").alias(x) for x in SHAPE), "pixels")
    kind = to_arrow_type(frames.schema[key].dataType)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sums() -> Iterator[list]:
            names = (key, "batch", *SHAPE)
            for found, rows in itertools.groupby(_rows(batches), key=lambda r: [r[x] for x in names]):
                total, n = None, 0
                for row in rows:
                    image = np.frombuffer(row["pixels"].as_buffer(), np.uint8)
                    total = image.astype(np.int32) if total is None else np.add(total, image, out=total)
                    n += 1
                yield [*found, n, total.tobytes()]

        kinds = [(key, kind), ("batch", pa.int64()), *((x, pa.int32()) for x in SHAPE), ("n", pa.int64()), ("sums", pa.binary())]
        yield from _gathered(sums(), pa.schema(kinds))

    return lean.mapInArrow(add, f"`{key}` {frames.schema[key].dataType.simpleString()}, batch long, height int, width int, channels int, n long, sums binary")


def mean_of(parts: list[dict]) -> np.ndarray:
    """A-11: the mean image (height, width, channels) of partial sums, cut to whole numbers."""
    shapes = {(p["height"], p["width"], p["channels"]) for p in parts}
    if len(shapes) > 1:
        raise ValueError(f"frames of one batch differ in shape: {sorted(shapes)}")
    total = sum(np.frombuffer(p["sums"].as_buffer(), np.int32).astype(np.int64) for p in parts)
    return (total // sum(p["n"] for p in parts)).reshape(*shapes.pop())


def batch_images(frames: DataFrame, size: int = 20, key: str = "video") -> DataFrame:
    """S-14, A-11: key, batch, height, width, channels, n_frames and pixels (bytes) of the mean image of each batch; the last may be short."""

    kind = to_arrow_type(frames.schema[key].dataType)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [(key, kind), ("batch", pa.int64()), *((x, pa.int32()) for x in SHAPE), ("n_frames", pa.int64()), ("pixels", pa.binary())]
        means = ([*(parts[0][x] for x in (key, "batch", *SHAPE)), sum(p["n"] for p in parts), mean_of(parts).astype(np.uint8).tobytes()] for parts in _runs(batches, key, "batch"))
        yield from _gathered(means, pa.schema(kinds))

    sums = batch_sums(frames, size, key).repartition(key, "batch").sortWithinPartitions(key, "batch")
    return sums.mapInArrow(merge, f"`{key}` {frames.schema[key].dataType.simpleString()}, batch long, height int, width int, channels int, n_frames long, pixels binary")


def filled_mask(spans: list[dict], height: int, width: int) -> np.ndarray:
    out = np.zeros((height, width))
    for s in spans:
        out[s["top"] : s["bottom"] + 1, s["low"] : s["high"] + 1] = 1
    return out


def prepared(image: np.ndarray, layers: list[list[dict] | None], most: int | None, area: bool) -> np.ndarray:
    """X-04: the gray image (whole numbers) that is registered: resized, faded under each layer of spans in turn, channels averaged."""
    height, width = scaled(*image.shape[:2], most)
    out = np.floor(resized(image.astype(np.float64), height, width, area) + 0.5) if image.shape[:2] != (height, width) else image.astype(np.float64)
    for spans in layers:
        if spans:
            out = blend(out, resized(filled_mask(spans, *image.shape[:2]), height, width))
    return np.floor(out.mean(axis=2) + 1e-9)


def correlated(images: np.ndarray, carried: np.ndarray | None, compat: bool) -> tuple[list[tuple[int, int, float]], np.ndarray]:
    """(dx, dy, confidence) of consecutive gray images (n, height, width), the first against the carried spectrum if there is one; and the last spectrum.

    A coefficient of size 0 (of a flat image) has no phase and stays 0.
    compat gives the plane that spectra in centred order give (K-13): the plane of the plain ones times a cosine.
    """
    height, width = images.shape[1:]
    spectra = np.fft.rfft2(images * window(height, width))
    if carried is not None:
        spectra = np.concatenate([carried[None], spectra])
    product = spectra[:-1] * np.conj(spectra[1:])
    size = np.abs(product)
    planes = np.fft.irfft2(product / np.where(size > 0, size, 1), s=(height, width))
    if compat:
        turn = (height // 2 * np.arange(height) / height)[:, None] + (width // 2 * np.arange(width) / width)[None, :]
        planes = planes * np.cos(2 * np.pi * turn)
    rows, columns = np.divmod(planes.reshape(len(planes), height * width).argmax(axis=1), width)
    return [(wrap(int(c), width, compat), wrap(int(r), height, compat), float(p[r, c])) for p, r, c in zip(planes, rows, columns, strict=True)], spectra[-1]


def register_frames(frames: DataFrame, masks: DataFrame | None = None, size: int = 20, most: int | None = 512, area: bool = False, compat: bool = True, key: str = "video") -> DataFrame:
    """X-04: rows (key, pair_idx, dx, dy, confidence) of the batches of frames, as segments.steady_segments reads them.

    masks: key, batch, text and persons, spans in the frames' size that are
    faded out in this order; a batch without a row, or with null or empty
    spans, stays as it is. A video of one batch has no pairs (K-07).
    """
    sums = batch_sums(frames, size, key)
    layers = ("text", "persons")
    if masks is not None:
        sums = sums.join(masks.select(key, "batch", *layers), [key, "batch"], "left")
    else:
        sums = sums.withColumns({x: F.lit(None).cast("array<struct<top: int, bottom: int, low: int, high: int>>") for x in layers})
    span = F.floor(F.col("batch") / SPAN)
    both = F.when((F.col("batch") % SPAN == 0) & (F.col("batch") > 0), F.array(span - 1, span)).otherwise(F.array(span))
    dealt = sums.withColumn("span", F.explode(both)).repartition(key, "span").sortWithinPartitions(key, "span", "batch")

    kind = to_arrow_type(frames.schema[key].dataType)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def stretch(runs: Iterator[list[dict]]) -> Iterator[list]:
            """Pairs of one stretch of a video; one spectrum is carried from one stack of images to the next."""
            images, at, carried = [], None, None
            for last, parts in _with_last(runs):
                at = parts[0]["batch"] if at is None else at
                images.append(prepared(mean_of(parts), [parts[0][x] for x in layers], most, area))
                if last or len(images) * images[0].size >= PIXELS:
                    found, spectrum = correlated(np.stack(images), carried, compat)
                    start = at if carried is None else at - 1
                    yield from ([parts[0][key], start + k, *pair] for k, pair in enumerate(found))
                    images, at, carried = [], at + len(images), spectrum

        kinds = [(key, kind), ("pair_idx", pa.int64()), ("dx", pa.int32()), ("dy", pa.int32()), ("confidence", pa.float64())]
        stretches = itertools.groupby(_runs(batches, key, "span", "batch"), key=lambda parts: (parts[0][key], parts[0]["span"]))
        yield from _gathered((pair for _, runs in stretches for pair in stretch(runs)), pa.schema(kinds))

    return dealt.mapInArrow(pairs, f"`{key}` {frames.schema[key].dataType.simpleString()}, pair_idx long, dx int, dy int, confidence double")


def _with_last(items: Iterator) -> Iterator[tuple[bool, object]]:
    """Each item, and whether it is the last."""
    items = iter(items)
    before = next(items, None)
    for item in items:
        yield False, before
        before = item
    if before is not None:
        yield True, before
