"""Column-level helpers: text, vectors, default models and fixed values."""

from tidemark.functions import fixed, models, text, vectors

__all__ = ["fixed", "models", "text", "vectors"]
