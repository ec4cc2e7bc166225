"""Structured Streaming: masking of messages, reassembly of event streams, a mapping that expires."""
