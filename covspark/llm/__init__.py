"""Operators for building training corpora, each a distributed Spark job."""
