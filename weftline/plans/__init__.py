"""Registered queries: the operators applied to the star-schema and text tables."""

from weftline.plans import couplings, graphs, history, indexes, reviews, surveys, texts  # noqa: F401
