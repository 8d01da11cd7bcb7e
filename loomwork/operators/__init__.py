"""Operators over DataFrames: rules, ranking, distance search, duplicates, change data, extraction, search."""
