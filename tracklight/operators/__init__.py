"""Relational operators on ordered lists, listening history, mappings and playlists."""
