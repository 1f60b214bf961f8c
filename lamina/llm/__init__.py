"""Training-data operators: search, filtering, near-duplicate joins, mixing and packing.

Nothing else in the library imports this subpackage.  Every operator is a
function from DataFrames to a DataFrame; `entries` binds them to the tables of
a data directory.
"""
