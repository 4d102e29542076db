"""Renderers of paragraph tables: plain text, Markdown, HTML, Word packages."""
