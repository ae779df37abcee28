"""Image registration by phase-only correlation (V-17..V-23, X-04, A-20, F-22).

The only Python operator of the steady-camera chain: images of a video's
batches meet in one group, each spectrum is computed once and used for two
pairs. The result is the table of pairs that the segment operators read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import masks

_WINDOWS: dict[tuple[int, int], np.ndarray] = {}


def window(height: int, width: int) -> np.ndarray:
    """V-17: root of the outer product of Hamming windows, from 1e-6 to 1; made once per shape and task."""
    if (height, width) not in _WINDOWS:
        _WINDOWS[height, width] = np.sqrt(np.clip(np.outer(np.hamming(height), np.hamming(width)), 1e-6, 1.0))
    return _WINDOWS[height, width]


def spectrum(image: np.ndarray, compat: bool = True) -> np.ndarray:
    """V-18; compat keeps the centred order of frequencies (K-13)."""
    raw = np.fft.fft2(image * window(*image.shape))
    return np.fft.fftshift(raw) if compat else raw


#: Pairs of a video that one task registers.
SPAN = 64


def wrap(index: int, size: int, compat: bool = True) -> int:
    """V-21; compat gives size - 1 - index, without sign, beyond half of the size (K-14)."""
    if index <= size / 2:
        return int(index)
    return int(size - 1 - index) if compat else int(index - size)


def correlate(reference: np.ndarray, target: np.ndarray, compat: bool = True, direct: bool = False) -> tuple[int, int, float]:
    """V-19: dx, dy and confidence of two spectra; direct (V-20) takes target * conj(reference)."""
    if reference.shape != target.shape:
        raise ValueError("spectra differ in shape")
    product = target * np.conj(reference) if direct else reference * np.conj(target)
    size = np.abs(product)
    if (size > 0).all():
        product = product / size
    plane = np.real(np.fft.ifft2(product))
    row, column = np.unravel_index(plane.argmax(), plane.shape)
    return wrap(column, plane.shape[1], compat), wrap(row, plane.shape[0], compat), float(plane[row, column])


def wrapped(index: Column, size: Column, compat: bool = True) -> Column:
    """V-21 as an expression."""
    return F.when(index > size / 2, size - 1 - index if compat else index - size).otherwise(index)


def scaled_size(width: Column, height: Column, most: int = 1024) -> tuple[Column, Column]:
    """F-22: both sides scaled so that the longer one is `most`, up or down, rounded half up."""
    k = F.lit(float(most)) / F.greatest(width, height)
    return F.floor(width * k + 0.5).cast("int"), F.floor(height * k + 0.5).cast("int")


def blend(image: np.ndarray, mask: np.ndarray, kernel: int = 21, sigma: float = 7.0, threshold: float = 0.1) -> np.ndarray:
    """V-22: what the mask covers fades into the image's mean, channel by channel."""
    soft = _blur((_blur(mask, kernel, sigma) > threshold).astype(np.float64), kernel, sigma)
    soft = soft if image.ndim == 2 else soft[..., None]
    mean = image.mean() if image.ndim == 2 else image.reshape(-1, image.shape[-1]).mean(axis=0)
    return image * (1 - soft) + mean * soft


def _blur(plane: np.ndarray, kernel: int, sigma: float) -> np.ndarray:
    half = kernel // 2
    taps = np.exp(-0.5 * (np.arange(-half, half + 1) / sigma) ** 2)
    taps /= taps.sum()
    for axis in (0, 1):
        padded = np.pad(plane, [(half, half) if a == axis else (0, 0) for a in (0, 1)], mode="reflect" if min(plane.shape) > half else "edge")
        n = plane.shape[axis]
        plane = sum(t * padded.take(range(k, k + n), axis) for k, t in enumerate(taps))
    return plane


def rectangles(shape: tuple[int, int], boxes: list[tuple[int, int, int, int]]) -> np.ndarray:
    """V-23: 1 inside boxes (x1, y1, x2, y2), ends included."""
    out = np.zeros(shape)
    for x1, y1, x2, y2 in boxes:
        out[max(0, y1) : y2 + 1, max(0, x1) : x2 + 1] = 1
    return out


def polygons(shape: tuple[int, int], shapes: list[np.ndarray]) -> np.ndarray:
    """V-23: 1 at points inside polygons (rows x, y), by crossing counts."""
    rows, columns = np.mgrid[: shape[0], : shape[1]]
    out = np.zeros(shape, bool)
    for corners in shapes:
        inside = np.zeros(shape, bool)
        for (x1, y1), (x2, y2) in zip(corners, np.roll(corners, -1, axis=0), strict=True):
            if y1 != y2:
                inside ^= ((rows >= min(y1, y2)) & (rows < max(y1, y2))) & (columns < (x2 - x1) * (rows - y1) / (y2 - y1) + x1)
        out |= inside
    return out.astype(np.float64)


def unite_masks(masks: list[np.ndarray]) -> np.ndarray:
    """A-20: sum of masks, 1 at most."""
    return np.clip(np.sum(masks, axis=0), 0, 1)


def masked(images: DataFrame, kernel: int = 21, sigma: float = 7.0, threshold: float = 0.1) -> DataFrame:
    """X-04, V-22, V-23, A-20: images (height, width, pixels, boxes: lists of x1, y1, x2, y2) faded out under the union of their boxes.

    An image without boxes stays as it is. Further columns pass through.
    """

    def fade(batches):
        for batch in batches:
            pixels = []
            for flat, height, width, boxes in zip(batch["pixels"], batch["height"], batch["width"], batch["boxes"], strict=True):
                image = np.asarray(flat, np.float64).reshape(height, width)
                masks = [rectangles(image.shape, [tuple(map(int, b))]) for b in boxes] if boxes is not None else []
                pixels.append((blend(image, unite_masks(masks), kernel, sigma, threshold) if masks else image).reshape(-1))
            yield batch.assign(pixels=pixels)

    return images.mapInPandas(fade, images.schema)


def covered(images: DataFrame) -> DataFrame:
    """A-20: images (height, width, boxes) with `covered`, the pixels under the union of their boxes; no pixel is made."""
    return images.withColumn("covered", masks.area(masks.box_spans(F.col("boxes"), F.col("height"), F.col("width"))).cast("int"))


def register(batches: DataFrame, compat: bool = True, key: str = "video") -> DataFrame:
    """X-04, V-19: rows (key, pair_idx, dx, dy, confidence) of batches (key, batch, height, width, pixels: flat gray image).

    One group for each SPAN pairs of a video, so that a long video is many
    tasks; the batch between two spans goes to both. A video of one batch has
    no pairs (K-07).
    """
    place = F.row_number().over(W.partitionBy(key).orderBy("batch")) - 1
    span = F.floor(F.col("__place") / SPAN)
    both = F.when((F.col("__place") % SPAN == 0) & (F.col("__place") > 0), F.array(span - 1, span)).otherwise(F.array(span))
    dealt = batches.withColumn("__place", place).withColumn("__span", F.explode(both))

    def pairs(table: pd.DataFrame) -> pd.DataFrame:
        table = table.rename(columns={"__place": "place"}).sort_values("place")
        rows, before = [], None
        for one in table.itertuples(index=False):
            now = spectrum(np.asarray(one.pixels, np.float64).reshape(one.height, one.width), compat)
            if before is not None:
                rows.append((getattr(one, key), one.place - 1, *correlate(before, now, compat)))
            before = now
        return pd.DataFrame(rows, columns=[key, "pair_idx", "dx", "dy", "confidence"])

    kind = batches.schema[key].dataType.simpleString()
    return dealt.groupBy(key, "__span").applyInPandas(pairs, f"{key} {kind}, pair_idx long, dx int, dy int, confidence double")
