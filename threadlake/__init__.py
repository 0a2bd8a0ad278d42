"""Spark-native search, grounding and corpus-processing library."""
