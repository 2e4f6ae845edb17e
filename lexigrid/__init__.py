"""Lexical and corpus analytics on Spark DataFrames."""
