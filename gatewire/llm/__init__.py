"""Operators for building language-model training corpora; nothing else in the package imports them."""
