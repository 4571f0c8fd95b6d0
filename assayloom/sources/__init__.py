"""Scans of matrices, sample tables and result files, and sinks."""
