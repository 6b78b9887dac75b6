"""Batch audits of crawled pages, and corpus operators, on Spark."""
