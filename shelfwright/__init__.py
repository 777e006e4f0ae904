"""Shelfwright: a Spark-native engine for cleaning, matching and auditing media libraries."""
