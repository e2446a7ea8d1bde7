"""Lodestone: a knowledge-store and analytics engine expressed in PySpark."""
