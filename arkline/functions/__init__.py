"""Scalar functions over paths, hashes, text and bytes."""
