"""Readers with explicit schemas, literal tables, and writers."""
