"""Move, check and describe tables at scale with Spark."""
