"""Cohort and denominator analytics as Spark DataFrame operators."""
