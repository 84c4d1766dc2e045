"""Sluiceway: collection, validation and keyed-state operators for Spark DataFrames."""
