"""leafmill: a Spark-native engine that turns collections of documents into clean, queryable data."""
