"""A Spark-native engine that turns source trees into API documentation data."""
