"""Usage dashboard: every table the administrator sees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopyflow.operators import usage


def dashboard(events: DataFrame, as_of: str) -> dict[str, DataFrame]:
    """Named result tables over one event table; ``as_of`` is the day called today."""
    return {
        "totals": usage.totals(events, F.lit(as_of).cast("date")),
        "users": usage.per_user(events),
        "kinds": usage.per_kind(events),
        "days": usage.per_day(events),
        "pages": usage.per_page(events),
        "targets": usage.per_target(events),
        "recent": usage.recent(events),
    }
