"""Training-data pipeline operators: filtering, search, sharding, dedup, scoring, formatting, mixing and packing."""
