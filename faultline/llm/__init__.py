"""Operators for preparing training text: deduplication, filtering, formatting, sharding, packing.

Each operator has a module with a general interface; ``workload`` registers one query per operator.
Nothing outside this subpackage imports it.
"""
