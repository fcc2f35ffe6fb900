"""The query catalogue: importing it registers every query."""

from . import evaluation, extra, files, models, more, positions, ranges, relational, tables, text, vectors  # noqa: F401
from .registry import ORACLE, QUERIES  # noqa: F401
