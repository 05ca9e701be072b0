"""Cataloguing and querying binary resource archives and their metadata with PySpark DataFrames."""
