"""Stages: DataFrame to DataFrame."""
