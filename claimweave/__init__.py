"""Typed discourse graphs over a corpus of papers, as PySpark DataFrames."""

from claimweave.session import configure, settle

__all__ = ["configure", "settle"]
