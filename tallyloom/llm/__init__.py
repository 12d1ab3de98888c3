"""Operators that prepare training corpora; nothing outside this folder imports it."""
