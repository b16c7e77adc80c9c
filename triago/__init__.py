"""Spark-native document triage: score, extract, normalise, decide, file and review."""
