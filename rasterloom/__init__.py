"""Moving-window and grid analytics as Spark DataFrame operators."""
