"""Spark jobs that turn document collections into evaluation benchmarks and score answers against them."""
