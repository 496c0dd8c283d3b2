"""Trust-weighted ranking and data-quality analytics as Spark DataFrame operators."""
