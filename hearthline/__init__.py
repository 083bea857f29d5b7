"""Hearthline: home-sensor telemetry on Spark DataFrames."""
