"""Reads, audits, lifecycle folds, status reports and market analytics over DataFrames."""
