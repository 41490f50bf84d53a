"""Operators of a training-data pipeline, each with its query; nothing outside this folder imports it."""
