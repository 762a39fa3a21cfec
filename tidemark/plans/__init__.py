"""Definitions, matchers and facet filters compiled to Spark columns."""
