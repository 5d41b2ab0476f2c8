"""Corpus rating, selection and evaluation on Spark."""
