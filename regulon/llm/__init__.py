"""Training-data operators on Spark DataFrames.

One module per operator; ``queries`` registers the thin ``opN_*`` queries over
the given tables. Nothing else in the library imports this package.
"""
