"""Budgeted context selection over code and text corpora, expressed as Spark jobs."""
