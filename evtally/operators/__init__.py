"""Stages of the accounting plan; each takes and gives DataFrames."""
