"""Payloads that keep arriving.  Beyond what the engine's batch semantics ask for."""
