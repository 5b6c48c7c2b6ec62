"""tidemill: event ingestion, cleaning and analytics as composable Spark operators."""
