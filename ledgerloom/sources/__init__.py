"""Readers of containers. Files are found and read by Spark, so any store it knows will do."""
