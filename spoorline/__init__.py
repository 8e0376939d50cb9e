"""Camera-trap analytics as Spark DataFrame operators.

``functions`` hold column expressions, ``operators`` turn DataFrames into
DataFrames, ``sources`` read and write tables and files, ``plans`` compose whole
jobs, ``streaming`` handles arriving images and ``driver`` registers the queries
that are checked against plain SQL.
"""

__version__ = "0.1.0"
