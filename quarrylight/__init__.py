"""Spark-first analytics over source repositories: inventory, search, graph, history, fusion and evaluation."""
