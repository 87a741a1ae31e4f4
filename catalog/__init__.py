"""Registered queries: the library's operators on the driver tables, with oracle SQL."""
