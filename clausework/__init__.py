"""Contract-parameter analytics on Spark: ledger, extraction, review, workflow and search."""

from clausework.session import scratch_path, tune

__all__ = ["scratch_path", "tune"]
