"""Operators composed into whole plans."""
