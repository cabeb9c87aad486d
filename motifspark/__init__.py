"""Sequence-motif analytics as PySpark DataFrame operators."""
