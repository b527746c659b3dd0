"""Connected components: those of the graph operators."""

from ..operators.graph import components

__all__ = ["components"]
