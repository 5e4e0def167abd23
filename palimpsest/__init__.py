"""Conversational-memory analytics on Spark."""
