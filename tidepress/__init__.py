"""tidepress: a Spark-native archive of articles with hybrid retrieval and upkeep."""
