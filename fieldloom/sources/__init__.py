"""Readers: Word packages, HTML, databases, variable files, included documents."""
