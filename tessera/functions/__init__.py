"""Column functions: dynamic values, canonical JSON, patterns."""
