"""The stages as temporary views, for questions asked in SQL."""

from __future__ import annotations

from curbside.plans.clock_times import binned
from curbside.plans.seasons import with_season
from curbside.stages import TicketStages


def register_views(stages: TicketStages) -> list[str]:
    """Register every stage and derived table; returns the names of the views.

    Views hold plans, not rows: no job runs until a statement uses one. Views of
    shared stages that are not prepared compute from the source; prepare the stages
    first to have them read the written table.
    """
    clean = stages.clean(*stages.columns, "issue_dt", "hour", "am_pm")
    views = {
        "raw_tickets": stages.raw(),
        "deduplicated_tickets": stages.deduplicated(),
        "valid_tickets": stages.valid(),
        "clean_tickets": clean,
        "timed_tickets": binned(clean),
        "seasonal_tickets": with_season(clean),
    }
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return list(views)
