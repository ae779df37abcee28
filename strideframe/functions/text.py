"""String, path and link expressions (F-01..F-14, P-05, P-07, P-08)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def fold_ascii(text: Column) -> Column:
    """A-Z in lower case; other letters keep their case (K-02)."""
    return F.translate(text, UPPER, LOWER)


def has_token(text: Column, token: str) -> Column:
    """P-05: text LIKE '%token%', ASCII case-insensitive, % and _ in the token are wildcards, no escape character."""
    pattern = token.translate(str.maketrans(UPPER, LOWER)).replace("\\", "\\\\")
    return fold_ascii(text).like(f"%{pattern}%")


def valid_url(url: Column) -> Column:
    """P-08: at least as long as an id."""
    return F.coalesce(F.length(url) >= 11, F.lit(False))


def id_from_url(url: Column) -> Column:
    """F-05: the last 11 characters before the first "&t="."""
    return F.right(F.split_part(url, F.lit("&t="), F.lit(1)), F.lit(11))


def id_from_stem(stem: Column) -> Column:
    """F-06."""
    return F.right(stem, F.lit(11))


def channel_id(stem: Column) -> Column:
    """F-07."""
    return F.concat(F.lit("@"), stem)


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/]*$", 0)


def stem(name: Column) -> Column:
    """F-08: without the last extension."""
    return F.regexp_replace(name, r"\.[^.]*$", "")


def short_stem(name: Column) -> Column:
    """F-08, the other form: up to the first dot."""
    return F.split_part(name, F.lit("."), F.lit(1))


def extension(name: Column) -> Column:
    """P-07: the last extension with its dot, or an empty string."""
    return F.regexp_extract(name, r"\.[^.]+$", 0)


def zero_pad(number: Column, width: int = 5) -> Column:
    """Digits filled up with zeros; longer numbers are kept whole, unlike lpad."""
    digits = number.cast("string")
    return F.when(F.length(digits) >= width, digits).otherwise(F.lpad(digits, width, "0"))


def chapter_link(video_id: Column, start: Column, end: Column, base: str = "https://youtu.be/") -> Column:
    """F-01: bounds are cut to whole seconds."""
    return F.concat(F.lit(base), video_id, F.lit("?start="), start.cast("int").cast("string"), F.lit("&end="), end.cast("int").cast("string"))


def embed_link(video_id: Column, start: Column, end: Column, base: str = "https://www.youtube.com") -> Column:
    """F-02."""
    return chapter_link(video_id, start, end, f"{base}/embed/")


def watch_link(video_id: Column, base: str = "https://www.youtube.com") -> Column:
    """F-02."""
    return F.concat(F.lit(f"{base}/watch?v="), video_id)


def clip_bounds(start: Column, end: Column, offset: int = 1) -> tuple[Column, Column]:
    """F-03: whole seconds, widened by offset, not below 0."""
    return F.greatest(F.lit(0), start.cast("int") - offset), end.cast("int") + offset


def clip_name(video_id: Column, start: Column, end: Column, ext: str = "mp4") -> Column:
    """F-04."""
    return F.concat(video_id, F.lit("__"), start.cast("string"), F.lit("-"), end.cast("string"), F.lit(f"__.{ext}"))


def segment_name(base: Column, filter_name: str, start: Column, end: Column) -> Column:
    """F-09."""
    return F.concat(base, F.lit(f"__{filter_name}_"), zero_pad(start), F.lit("-"), zero_pad(end), F.lit("__.mp4"))


def fragment_name(*parts: Column) -> Column:
    """F-10: parts joined by underscores."""
    return F.concat(F.concat_ws("_", *[p.cast("string") for p in parts]), F.lit(".mp4"))


def mirrored_name(name: Column) -> Column:
    """F-12."""
    return F.concat(F.lit("M"), name)


def array_path(path: Column, root: str, new_root: str) -> Column:
    """F-13: another root folder, and npy for the last three characters."""
    moved = F.replace(path, F.lit(root), F.lit(new_root))
    return F.concat(F.substring(moved, F.lit(1), F.length(moved) - 3), F.lit("npy"))


def dataset_of(path: Column) -> Column:
    """F-13, S-06: the third path component."""
    return F.split_part(path, F.lit("/"), F.lit(3))


def frame_number(image: Column) -> Column:
    """F-14: the number in a name like 17.jpg."""
    return F.substring(image, F.lit(1), F.length(image) - 4).cast("int")


def frame_rate(ratio: Column) -> Column:
    """F-21, S-15: "num/den" as a number; null where den is 0."""
    return F.try_divide(F.split_part(ratio, F.lit("/"), F.lit(1)).cast("double"), F.split_part(ratio, F.lit("/"), F.lit(2)).cast("double"))
