"""Readers, writers and external adapters."""
