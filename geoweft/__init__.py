"""Geospatial analytics operators as lazy PySpark DataFrame functions."""
