"""Readers that give tickets in the shape of :mod:`curbside.schema`."""
