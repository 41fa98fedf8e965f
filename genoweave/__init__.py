"""Genome segmentation and corpus preparation as Spark jobs."""
