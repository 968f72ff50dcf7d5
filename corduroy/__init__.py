"""corduroy: Spark-native analytics for events, roads and data quality."""
