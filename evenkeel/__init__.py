"""Temporally stable rolling analytics on Spark."""
