"""Tessera: Spark-native batch analytics, written with DataFrame expressions."""
