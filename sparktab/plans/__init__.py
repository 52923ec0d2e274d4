"""Whole plans: compression and decompression of many payloads, and the query workload."""
