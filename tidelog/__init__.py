"""tidelog: a Spark-native analytics library over ordered key-value operation logs."""
