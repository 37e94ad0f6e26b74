"""Text-reuse analytics as Spark plans."""
