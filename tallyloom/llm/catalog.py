"""Loads every operator module so that the registry is complete."""

from tallyloom.llm import (  # noqa: F401
    chains, decontaminate, html, langid, packing, periodic, pii, quality, simhash, substrings, treap, urls, warc,
)
from tallyloom.llm.common import ORACLES, QUERIES  # noqa: F401
