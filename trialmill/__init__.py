"""Evaluation and routing analytics over trial logs, corpora and fact tables, on Spark DataFrames."""

__version__ = "0.1.0"
