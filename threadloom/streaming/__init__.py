"""Structured Streaming: the incremental forms of read state, delta merge and notifications."""

from .flows import delta_merge, live_delta, notifications, read_state, windowed_activity

__all__ = ["delta_merge", "live_delta", "notifications", "read_state", "windowed_activity"]
