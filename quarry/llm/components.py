"""Connected components of a graph of links: those of the library's graphs."""

from quarry.operators.graph import components

__all__ = ["components"]
