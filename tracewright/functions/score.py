"""Numeric scores as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def visual_score(absdiff: Column, ssim_delta: Column, edge_delta: Column, hash_delta: Column) -> Column:
    return 0.40 * absdiff + 0.35 * ssim_delta + 0.15 * edge_delta + 0.10 * hash_delta


def segment_score(visual: Column, text_delta: Column, system_delta: Column, action: Column) -> Column:
    return 0.45 * visual + 0.25 * text_delta + 0.15 * system_delta + 0.15 * action


def coverage_minimum(events: Column) -> Column:
    """Steps that so many events must give at least."""
    return F.when(events >= 35, 24).when(events >= 30, 22).when(events >= 25, 18).otherwise(0)


def average_hash(pixels: Column) -> Column:
    """16 hex digits of the bits value > mean over 64 values, first value highest."""
    mean = F.aggregate(pixels, F.lit(0.0), lambda a, v: a + v.cast("double")) / F.size(pixels)
    bits = F.array_join(F.transform(pixels, lambda v: F.when(v.cast("double") > mean, "1").otherwise("0")), "")
    return F.lpad(F.lower(F.conv(bits, 2, 16)), 16, "0")


def seconds_in(x: Column) -> Column:
    """The first number of seconds in a string such as frame_0003_00012s.jpg."""
    return F.regexp_extract(F.coalesce(x, F.lit("")), r"(\d+(?:\.\d+)?)\s*s", 1).try_cast("double")
