"""barloom: market-panel analytics as Spark DataFrame operators keyed by (symbol, ts)."""
