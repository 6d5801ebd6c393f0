"""Imports every plan module, which registers its queries."""

from quizgrove.plans import access, learning, loaders, recommend, replicate, text  # noqa: F401
from quizgrove.plans.registry import ORACLE, QUERIES  # noqa: F401
