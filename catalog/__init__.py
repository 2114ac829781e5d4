"""Registered queries and their SQL forms."""

from . import traffic, fusing, stored, learning, live, verdicts  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
