"""Tessaline: matrices, graphs and point sets as Spark DataFrames."""
