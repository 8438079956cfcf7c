"""Operators for training-data pipelines. Nothing outside this folder imports it, corpus_pipeline.py apart."""
