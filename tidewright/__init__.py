"""tidewright: a Spark-native engine for judging generators of timed event sequences."""
