"""Connected components of an edge table by alternating stars."""

from lumiframe.operators.iterate import stars as components

__all__ = ["components"]
