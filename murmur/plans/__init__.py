"""Whole plans behind the serving surface."""
