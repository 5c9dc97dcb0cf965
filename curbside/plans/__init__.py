"""The questions, one module per subject; importing them fills the registry."""

from curbside.plans import (  # noqa: F401
    cleaning,
    clock_times,
    code_sets,
    distributions,
    examine,
    fines,
    frequencies,
    intake,
    periods,
    precincts,
    seasons,
    season_index,
    significance,
    source_tables,
    spellings,
    totals,
    years,
)
from curbside.plans.registry import REGISTRY

__all__ = ["REGISTRY"]
