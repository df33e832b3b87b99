"""Conversation checks, text-table curation and routing evaluation as Spark DataFrame operators."""
