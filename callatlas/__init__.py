"""Conversation coverage analytics on Spark."""
