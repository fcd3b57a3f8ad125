"""Operators over the logical tables. Each takes DataFrames and an explicit `now`, and declares its plan."""
