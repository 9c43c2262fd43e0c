"""Forensic analytics and corpus preparation on Spark."""
