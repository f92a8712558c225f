"""Spark-native cohorts, token tables, retrieval and scoring over event histories."""
