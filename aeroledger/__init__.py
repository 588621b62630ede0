"""Flight-operations analytics on Spark: star schema, KPI queries and delay models."""
