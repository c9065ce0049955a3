"""driftloom: market-signal change detection as Spark DataFrame jobs."""
