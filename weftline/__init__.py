"""Temporal-motif, table and graph analytics as Spark DataFrame plans."""
