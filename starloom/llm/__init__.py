"""Operators for building language-model training corpora, written for Spark."""
