"""Event analytics as Spark DataFrame transformations."""
