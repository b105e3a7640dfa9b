"""Cohort and feature engineering over relational records and long event tables, on Spark."""
