"""Reading record sets and keeping the registry's append-only tables."""
