"""Streaming forms of the operators."""

from .multiline import assemble_stream

__all__ = ["assemble_stream"]
