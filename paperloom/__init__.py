"""Document analytics as Spark plans."""
