"""ledgerlark: a Spark-native engine for listings of dated events."""
