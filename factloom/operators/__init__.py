"""Distributed operators of the core; every one takes and returns DataFrames."""
