"""Stellara: star-schema analytics and corpus preparation expressed as Spark DataFrame plans."""
