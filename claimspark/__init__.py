"""Spark jobs that turn page text and extracted records into comparable, evidence-backed facts."""
