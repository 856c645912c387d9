"""The load, rollup and assembly paths on Structured Streaming."""
