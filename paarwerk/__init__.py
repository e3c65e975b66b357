"""Spark-native engine for parallel "as written / as corrected" learner text."""
