"""factloom: claim comparison and corpus preparation expressed on the PySpark DataFrame API."""

from factloom.session import get_spark

__all__ = ["get_spark"]
