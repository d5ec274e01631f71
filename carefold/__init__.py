"""carefold: longitudinal clinical record analytics as Spark DataFrame operators."""
