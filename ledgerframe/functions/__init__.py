"""Column-level building blocks: JSON type tags, hashes, rule lists."""
