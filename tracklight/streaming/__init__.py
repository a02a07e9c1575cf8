"""Polling policy and incremental projection."""
