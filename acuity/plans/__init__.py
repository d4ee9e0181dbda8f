"""Whole jobs: the batch build, and the queries over the star-schema test tables."""
