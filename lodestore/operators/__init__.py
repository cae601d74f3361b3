"""Catalogue, change-log and cache operators over DataFrames."""
