"""gridloom: Spark-native analytics for grid-structured prediction pipelines."""
