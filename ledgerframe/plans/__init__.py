"""The registry: verbs that load tables, run an analysis and append its result."""
