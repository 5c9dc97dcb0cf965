"""DataFrame operators the questions are composed of."""

from curbside.operators.daily import fill_days, with_trend, years_before
from curbside.operators.dedup import compared_columns, keep_first
from curbside.operators.intervals import interval_join
from curbside.operators.itemsets import frequent_sets
from curbside.operators.lookup import join_by_size, join_small
from curbside.operators.marginals import marginals, summed_over
from curbside.operators.preview import preview
from curbside.operators.profile import column_profile, key_profile
from curbside.operators.quantiles import exact_quantiles
from curbside.operators.share import count_and_share
from curbside.operators.sketches import (
    count_error,
    distinct_estimates,
    listed_values,
    merge_states,
    sketch_states,
    sketched_top_k,
)
from curbside.operators.spellings import spelling_roots
from curbside.operators.step_up import (
    ERFC_FIT,
    likelihood_ratio,
    log_p_of_ratio,
    step_up,
)
from curbside.operators.topk import frequency, nested_top_k, top_k

__all__ = [
    "ERFC_FIT",
    "column_profile",
    "compared_columns",
    "count_and_share",
    "count_error",
    "distinct_estimates",
    "exact_quantiles",
    "fill_days",
    "frequency",
    "frequent_sets",
    "interval_join",
    "join_by_size",
    "join_small",
    "keep_first",
    "key_profile",
    "likelihood_ratio",
    "listed_values",
    "log_p_of_ratio",
    "marginals",
    "merge_states",
    "nested_top_k",
    "preview",
    "sketch_states",
    "sketched_top_k",
    "spelling_roots",
    "step_up",
    "summed_over",
    "top_k",
    "with_trend",
    "years_before",
]
