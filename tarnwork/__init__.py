"""Finding-triage analytics on Spark."""
