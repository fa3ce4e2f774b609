"""A Spark-native engine for set-based relational algebra."""
