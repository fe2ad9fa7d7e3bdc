"""Plate-assay time-series analytics as plain PySpark DataFrame functions."""
