"""Point-in-time analytics over event logs, as Spark plans."""
