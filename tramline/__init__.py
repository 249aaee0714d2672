"""Transit-feed (GTFS) analytics as Spark DataFrame jobs."""
