"""Braidwork: entity resolution and data fusion expressed as Spark DataFrame plans."""
