"""Typed graph operators: search, trace, reports, diff, schema, resolution."""
