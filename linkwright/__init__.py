"""Record linkage on Spark DataFrames."""

from .session import ship

__all__ = ["ship"]
