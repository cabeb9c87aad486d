"""Readers and writers of sequence and model files, and the adapter from text tables."""
