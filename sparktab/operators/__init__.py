"""Relational operators over cells, documents and stores."""
