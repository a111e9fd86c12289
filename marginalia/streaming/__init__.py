"""Structured Streaming counterparts of the step logs and incremental sinks."""
