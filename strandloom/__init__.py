"""Spark-native interval, chain and splice-graph analytics."""
