"""All registered queries of the engine's own operators."""

from . import composite, core, explained, flows, further, learned, modelling, more  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
