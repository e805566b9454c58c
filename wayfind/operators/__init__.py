"""Operators over DataFrames. Those on questions take a query_id column and answer all questions in one plan."""
