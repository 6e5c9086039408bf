"""Readers and writers of posts, lexicons and stop words."""
