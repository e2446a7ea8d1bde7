"""The collection-aware filter builder."""

from __future__ import annotations

from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EQUAL = ("evidence_tier", "source_tool", "category", "video_id")
RANGE = {"date_from": ">=", "date_to": "<="}


def parse_date(text: str | None) -> datetime | None:
    """An ISO date or time; without a zone it is UTC; what can't be read is no date."""
    try:
        found = datetime.fromisoformat(text or "")
    except ValueError:
        return None
    return found if found.tzinfo else found.replace(tzinfo=timezone.utc)


def build_filter(df: DataFrame, **conditions: str | None) -> Column | None:
    """AND of the conditions that have a value and whose property ``df`` has; None if there is none.

    Dates are parsed here, on the driver, so that scans get literals to push down.
    """
    unknown = set(conditions) - {*EQUAL, *RANGE}
    if unknown:
        raise ValueError(f"no such condition: {', '.join(sorted(unknown))}")
    parts = [F.col(c) == F.lit(conditions[c]) for c in EQUAL if conditions.get(c) and c in df.columns]
    for name, op in RANGE.items():
        date = parse_date(conditions.get(name))
        if date is not None and "created_at" in df.columns:
            at = F.lit(date)
            parts.append(F.col("created_at") >= at if op == ">=" else F.col("created_at") <= at)
    return reduce(lambda a, b: a & b, parts) if parts else None


def filters_applied(**conditions: str | None) -> dict[str, str]:
    """What a result reports: all conditions that were given, an empty string too."""
    return {k: v for k, v in conditions.items() if v is not None}


def apply_filter(df: DataFrame, **conditions: str | None) -> DataFrame:
    found = build_filter(df, **conditions)
    return df if found is None else df.filter(found)
