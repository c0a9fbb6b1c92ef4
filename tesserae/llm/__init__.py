"""Training-data operators: quality, duplicates, leaks, mixing, layout and formats of text corpora.

Every operator takes DataFrames and returns DataFrames. Nothing else in the library imports
this package; ``queries`` holds its registered queries and their SQL.
"""
