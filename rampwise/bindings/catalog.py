"""Importing this module registers every query."""

from rampwise.bindings import columns, frames, jobs, learning, matching, scoring  # noqa: F401
from rampwise.bindings.registry import ORACLES, QUERIES  # noqa: F401
