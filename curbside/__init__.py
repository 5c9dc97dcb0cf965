"""Curbside: analytics over municipal violation tickets on PySpark.

Yearly ticket files become one DataFrame with a ``file_fy`` column. It is
deduplicated, validated and bucketed, and every question is answered for all
fiscal years in a single pass of built-in DataFrame operators.
"""

from curbside.plans import REGISTRY
from curbside.sources.csv_tickets import (
    column_counts,
    lost_values,
    read_ticket_csv,
    read_ticket_years,
)
from curbside.sources.order_tables import tickets_from_order_tables
from curbside.stages import TicketStages, read_stages, write_stages
from curbside.views import register_views

__all__ = [
    "REGISTRY",
    "TicketStages",
    "column_counts",
    "lost_values",
    "read_stages",
    "read_ticket_csv",
    "read_ticket_years",
    "register_views",
    "tickets_from_order_tables",
    "write_stages",
]
