"""Spark-native market-evidence analytics and training-data operators."""
