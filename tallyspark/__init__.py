"""Personal-finance analytics on Spark: every computation runs for all persons at once."""
