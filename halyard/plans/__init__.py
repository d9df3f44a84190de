"""The filter language: text or builder, to a tree, to Spark columns."""

from halyard.plans.ast import Filter, FilterError
from halyard.plans.bind import Fields, evaluate, keep
from halyard.plans.parser import info, parse, try_parse, validate

__all__ = ["Fields", "Filter", "FilterError", "evaluate", "info", "keep", "parse", "try_parse", "validate"]
