"""Selection by prompt tokens (P-01..P-05, X-15..X-17, A-01, A-02)."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text


@dataclass(frozen=True)
class Prompt:
    """D5: tokens that must all, any and none occur, and open duration bounds (0: no bound)."""

    and_tokens: Sequence[str] = field(default_factory=tuple)
    or_tokens: Sequence[str] = field(default_factory=tuple)
    and_not_tokens: Sequence[str] = field(default_factory=tuple)
    minimum_duration: float = 0
    maximum_duration: float = 0

    @classmethod
    def from_json(cls, document: str) -> Prompt:
        """X-17, S-09."""
        found = json.loads(document)
        options = found.get("video_options") or {}
        lists = {k: tuple(found.get(k) or ()) for k in ("and_tokens", "or_tokens", "and_not_tokens")}
        return cls(**lists, minimum_duration=options.get("minimum_duration", 0), maximum_duration=options.get("maximum_duration", 0))


def any_token(title: Column, tokens: Sequence[str]) -> Column | None:
    """P-01 with OR; empty tokens are skipped, no token gives no predicate."""
    parts = [text.has_token(title, t) for t in tokens if t]
    return reduce(or_, parts) if parts else None


def every_token(title: Column, tokens: Sequence[str]) -> Column | None:
    """P-01 with AND."""
    parts = [text.has_token(title, t) for t in tokens if t]
    return reduce(and_, parts) if parts else None


def prompt_predicate(prompt: Prompt, title: Column, duration: Column) -> Column:
    """P-02: (all) AND (any) AND NOT (none) AND open bounds; a null title passes only where no tokens are given (K-01, K-03)."""
    parts = [every_token(title, prompt.and_tokens), any_token(title, prompt.or_tokens)]
    excluded = any_token(title, prompt.and_not_tokens)
    parts.append(~excluded if excluded is not None else None)
    parts.append(duration > prompt.minimum_duration if prompt.minimum_duration > 0 else None)
    parts.append(duration < prompt.maximum_duration if prompt.maximum_duration > 0 else None)
    return reduce(and_, [p for p in parts if p is not None], F.lit(True))


def select_videos(videos: DataFrame, prompt: Prompt, title: str = "title", duration: str = "duration") -> DataFrame:
    """P-02, X-17."""
    return videos.where(prompt_predicate(prompt, F.col(title), F.col(duration)))


def select_chapters(chapters: DataFrame, or_tokens: Sequence[str], exclude_tokens: Sequence[str] = (), title: str = "title") -> DataFrame:
    """P-03."""
    return chapters.where(prompt_predicate(Prompt(or_tokens=or_tokens, and_not_tokens=exclude_tokens), F.col(title), F.lit(0)))


def fan_out(chapters: DataFrame, tokens: Sequence[str], exclude_tokens: Sequence[str] = (), title: str = "title") -> DataFrame:
    """X-15: a row for each token and chapter it selects, with `token`.

    One scan: each chapter lists its tokens and is unfolded; no join.
    """
    kept = select_chapters(chapters, tokens, exclude_tokens, title)
    hits = F.array_compact(F.array(*[F.when(text.has_token(F.col(title), t), F.lit(t)) for t in dict.fromkeys(tokens) if t]))
    return kept.withColumn("token", F.explode(hits))


def token_counts(chapters: DataFrame, tokens: Sequence[str], exclude_tokens: Sequence[str] = (), title: str = "title") -> DataFrame:
    """A-02: chapters of each token (0 where none) and, with a null token, of all together."""
    every = chapters.sparkSession.createDataFrame([(t,) for t in dict.fromkeys(tokens) if t], "token string")
    counts = fan_out(chapters, tokens, exclude_tokens, title).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    filled = every.join(counts, "token", "left").select("token", F.coalesce("n", F.lit(0)).alias("n"))
    return filled.rollup("token").agg(F.sum("n").alias("n_chapters"))


def links_from_prompt(chapters: DataFrame, prompt: Prompt, title: str = "title") -> DataFrame:
    """X-16: token and link, a row for each chapter that the token selects."""
    found = fan_out(chapters, prompt.or_tokens, prompt.and_not_tokens, title)
    link = text.chapter_link(F.col("video_id"), F.col("start_time"), F.col("end_time"))
    return found.select("token", link.alias("link"))


def interval_statistics(rows: DataFrame, start: str = "start_time", end: str = "end_time", by: Sequence[str] = ()) -> DataFrame:
    """A-01: mean and population deviation of end - start."""
    length = F.col(end) - F.col(start)
    return rows.groupBy(*by).agg(F.avg(length).alias("mean_length"), F.stddev_pop(length).alias("std_length"))
