"""Spark jobs over recorded, tick-by-tick sessions: frames, actions and state."""
