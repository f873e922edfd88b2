"""tilequarry: map-tile planning, querying and packaging on PySpark DataFrames."""

__version__ = "0.1.0"
