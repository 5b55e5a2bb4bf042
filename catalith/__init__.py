"""Catalith: product-catalogue analytics as Spark DataFrame jobs."""
