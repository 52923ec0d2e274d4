"""Payloads and documents as tables."""
