"""Folding frames as they arrive: an extension beyond batch fusion."""
