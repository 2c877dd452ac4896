"""Tandem-mass-spectrum analytics expressed as Spark DataFrame transformations."""
