"""limpid: cleaning, profiling and dashboard analytics for messy tables, written on PySpark DataFrames."""

__version__ = "0.1.0"
