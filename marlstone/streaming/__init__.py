"""Structured Streaming: bars with a watermark, decayed flow as keyed state."""
