"""Structured Streaming: feeds of versions into stores and latest-state views."""
