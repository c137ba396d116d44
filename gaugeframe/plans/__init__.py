"""Declarative requests (table options, plots, data fields) turned into DataFrames."""
