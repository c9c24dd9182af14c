"""Evaluation, retrieval and evidence-fusion analytics as Spark jobs."""
