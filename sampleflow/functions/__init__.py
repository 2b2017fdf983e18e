"""Column functions over token arrays, all of built-in expressions."""

from .tokens import append_ends, as_tokens, checked_sizes, chunks_of, hex_bytes, padded, split_words

__all__ = ["append_ends", "as_tokens", "checked_sizes", "chunks_of", "hex_bytes", "padded", "split_words"]
