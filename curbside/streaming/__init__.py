"""Tickets that arrive as a stream of files."""

from curbside.streaming.intake import StreamIntake

__all__ = ["StreamIntake"]
