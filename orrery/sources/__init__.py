"""Readers, adapters and keyed table updates."""
