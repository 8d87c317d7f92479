"""LedgerFrame: dataset registry, verdicts and lineage analyses as Spark DataFrames."""

__version__ = "0.1.0"
