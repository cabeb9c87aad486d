"""Scalar functions on sequences and k-mers, and small numeric helpers."""
