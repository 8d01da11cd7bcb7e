"""Micro-batch jobs: the crawl queue, due sources, pages that changed."""
