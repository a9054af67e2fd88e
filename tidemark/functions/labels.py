"""Names of quantiles and metrics, and values kept as text."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def quantile_label(level: float) -> str:
    """``p025`` for 0.025, ``p50`` for 0.5: the decimals, two at least."""
    if not 0 < level < 1:
        raise ValueError(f"no quantile level: {level}")
    return "p" + f"{level:.10f}"[2:].rstrip("0").ljust(2, "0")


def quantile_level(label: str) -> float:
    """The level that ``quantile_label`` names."""
    if label[:1] != "p" or not label[1:].isdigit():
        raise ValueError(f"no quantile label: {label!r}")
    return float("0." + label[1:])


def flat_metrics(values: Mapping, prefix: str = "") -> dict[str, float]:
    """Numbers of nested mappings under names joined by slashes; text, lists and nulls are left out, booleans are 0 or 1."""
    out: dict[str, float] = {}
    for key, v in values.items():
        name = f"{prefix}{key}"
        if isinstance(v, Mapping):
            out |= flat_metrics(v, name + "/")
        elif isinstance(v, (bool, int, float)):
            out[name] = float(v)
    return out


def recovered(text: Column, kind: str) -> Column:
    """A value of the Spark type ``kind`` that was stored as JSON text; null where the text is none."""
    return F.from_json(text, kind)
