"""Operators and the pipeline for text corpora; nothing else in the library imports this folder."""
