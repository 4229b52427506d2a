"""regulon: Spark-native analytics for gene-perturbation prediction runs.

Every public operator takes DataFrames (or columns) and returns DataFrames (or
columns), so it composes with ``df.transform`` and stays inside Catalyst.
"""

__version__ = "0.1.0"
