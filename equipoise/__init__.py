"""Spark-native observational causal analysis: recode, score, match, balance, weight."""
