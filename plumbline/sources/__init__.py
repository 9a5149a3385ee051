"""Readers and sinks: envelopes, native logs, imports, versioned tables."""
