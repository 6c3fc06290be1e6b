"""Structured Streaming operators: file landing KPIs (T1) and feedback intake."""
