"""Operators of a training-data pipeline, each over DataFrames of documents or
embeddings. Nothing else in the library imports this subpackage."""
