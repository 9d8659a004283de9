"""Column functions."""

from tessera.functions.vectors import cosine, dot, norm

__all__ = ["cosine", "dot", "norm"]
