"""Importing this module registers every query."""

from gaugeframe.catalogue import runs, scalars, sources, tables, transforms  # noqa: F401
