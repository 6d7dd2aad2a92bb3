"""Spark-first engine for conversational and document memory."""
