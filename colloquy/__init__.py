"""colloquy: a Spark-first engine for timed, evidence-linked conversation data."""
