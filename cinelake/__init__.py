"""Media-catalog analytics on PySpark: tables of clips and their signals in, tables of decisions out."""

__version__ = "0.1.0"
