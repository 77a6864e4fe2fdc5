"""Operators of a large-scale training-data pipeline, over the engine's own records where it has them."""
