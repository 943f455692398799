"""Expressions and the renderer that both engines share."""
