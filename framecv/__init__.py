"""Entity-grouped, repeated-measurement tables on Spark."""
