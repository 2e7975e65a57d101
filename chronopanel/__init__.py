"""Panel time-series analytics on Spark DataFrames."""

from chronopanel.panel import Panel

__all__ = ["Panel"]
