"""Sequence analytics on PySpark: DataFrame -> DataFrame operators."""
