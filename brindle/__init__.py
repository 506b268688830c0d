"""Spark-first analytics for multichannel recordings and the tables around them."""
