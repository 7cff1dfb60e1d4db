"""Point-in-time research tables on Spark."""
