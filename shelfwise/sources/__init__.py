"""Readers, sinks and the canonical retail views."""
