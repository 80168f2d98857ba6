"""Readers and writers: CSV readings and metadata, level tables, forecasts, logs, reports."""
