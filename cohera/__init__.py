"""Group-aware conformal analytics as Spark DataFrame operators."""
