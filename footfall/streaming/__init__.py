"""Incremental runs: resume by key, merge shards, generate with committed chunks. There is no unbounded
input in this domain, so these are bounded jobs that a scheduler repeats.
"""
