"""Retrieval, evaluation, cleaning, chunking and dialogue operators over DataFrames."""
