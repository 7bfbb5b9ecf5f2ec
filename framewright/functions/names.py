"""Capture and result names: formatting them and reading facts back out of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from framewright import constants as C

# Fixed patterns of the capture settings string and the dated capture name.
NUMBER = r"[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"
SETTINGS = rf"(?i)^\s*fps=({NUMBER})\s*gain=({NUMBER})\s*exp=({NUMBER})\s*$"
DATED = r"([0-9]{4}-[0-9]{2}-[0-9]{2})-([0-9]{2})([0-9]{2})_([0-9])"


def truth_name(seed: Column, regime: Column) -> Column:
    return F.format_string("gate1_Dr0-%d_seed-%05d", regime.cast("long"), seed.cast("long"))


def seed_of(name: Column) -> Column:
    return F.regexp_extract(name, r"seed-([0-9]+)", 1).cast("long")


def regime_of(name: Column) -> Column:
    return F.regexp_extract(name, r"Dr0-([0-9.]+)_", 1).cast("double")


def quality_tag(frames: Column, weighted_quality: Column, snr: Column | None = None) -> Column:
    tag = F.format_string("-n%d-q%.3f", frames, weighted_quality)
    return tag if snr is None else F.concat(tag, F.coalesce(F.format_string("-snr%.0f", snr), F.lit("")))


def exposure_seconds(settings: Column) -> Column:
    """Exposure from a complete ``fps=.. gain=.. exp=..`` string (milliseconds), else null."""
    fps = F.regexp_extract(settings, SETTINGS, 1).try_cast("double")
    exposure = F.regexp_extract(settings, SETTINGS, 3).try_cast("double")
    return F.when(settings.rlike(SETTINGS) & (fps > 0) & (exposure > 0), exposure / 1000)


def planet_of(name: Column) -> Column:
    """The planet named by whole-word tokens, when exactly one distinct planet is named."""
    alias = {**{p: p for p in C.SIDEREAL_DAYS}, **C.PLANET_ALIASES}
    table = F.create_map(*[F.lit(x) for pair in alias.items() for x in pair])
    tokens = F.regexp_extract_all(F.lower(name), F.lit("([a-z]+)"))
    found = F.array_distinct(F.array_compact(F.transform(tokens, lambda t: F.try_element_at(table, t))))
    return F.when(F.size(found) == 1, F.element_at(found, 1))


def rotation_rate(planet: Column, reverse: bool = False) -> Column:
    """Sidereal rotation in rad/s from the preset periods, null for an unknown planet."""
    days = F.create_map(*[F.lit(x) for pair in C.SIDEREAL_DAYS.items() for x in pair])
    sign = -1.0 if reverse else 1.0
    return F.lit(sign * 2 * 3.141592653589793) / (F.try_element_at(days, planet) * 86400)


def retimed_name(stem: Column, offset_s: Column, utc_s: Column | None = None) -> Column:
    """Move the dated minute of a capture name to another epoch.

    The named tenth of a minute spans six seconds and is taken at its centre; an
    epoch within 0.05 s of the midpoint keeps the name, and a recorded UTC wins.
    """
    named = F.try_to_timestamp(
        F.concat_ws(" ", F.regexp_extract(stem, DATED, 1),
                    F.concat_ws(":", F.regexp_extract(stem, DATED, 2), F.regexp_extract(stem, DATED, 3))),
        F.lit("yyyy-MM-dd HH:mm"))
    micros = F.unix_micros(named) + (
        (F.regexp_extract(stem, DATED, 4).try_cast("int") * 6 + 3 + offset_s) * 1_000_000).cast("long")
    if utc_s is not None:
        micros = F.coalesce((utc_s * 1_000_000).cast("long"), micros)
    moment = F.timestamp_micros(micros)
    stamp = F.concat(F.date_format(moment, "yyyy-MM-dd-HHmm"), F.lit("_"),
                     F.floor(F.second(moment) / 6).cast("string"))
    keep = ~stem.rlike(DATED) | offset_s.isNull() | (F.abs(offset_s) < 0.05)
    return F.when(keep, stem).otherwise(F.regexp_replace(stem, F.lit(DATED), stamp))


def free_name(base: Column, position: Column, extension: str) -> Column:
    """Collision-free output name: the second use of a base gets -2, the third -3, ..."""
    suffix = F.when(position > 1, F.concat(F.lit("-"), position.cast("string"))).otherwise(F.lit(""))
    return F.concat(base, suffix, F.lit(extension))
