"""Methylation-motif analytics and data-quality operators on PySpark DataFrames."""
