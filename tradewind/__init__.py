"""Marketplace sales analytics expressed as Spark DataFrame plans."""
