"""Scalar functions as Columns; markup and fingerprints as Arrow functions."""
