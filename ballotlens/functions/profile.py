"""What a column's cells look like: kinds, ranges and sketches that merge."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd

#: Registers of each min-hash sketch.
REGISTERS = 12
KINDS = ("whole", "decimal", "boolean", "timestamp", "text")
_LETTERS, _DIGITS = re.compile(r"[^\W\d_]+"), re.compile(r"\d+")
_WHOLE, _DECIMAL = re.compile(r"[+-]?[0-9]+\Z"), re.compile(r"[+-]?([0-9]+\.[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\Z")
_TIME = re.compile(r"[0-9]{4}-[0-9]{2}-[0-9]{2}([ T][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]+)?)?( ?Z|[+-][0-9]{2}:?[0-9]{2})?)?\Z|[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}( [0-9]{1,2}:[0-9]{2}(:[0-9]{2})?( ?[AaPp][Mm])?)?\Z")


def cell_kind(text: str) -> str:
    """whole, decimal, boolean, timestamp or text; the cell must not be empty."""
    if _WHOLE.match(text):
        return "whole"
    if _DECIMAL.match(text):
        return "decimal"
    if text.lower() in ("true", "false"):
        return "boolean"
    return "timestamp" if _TIME.match(text) else "text"


def pattern(text: str) -> str:
    """The text with runs of digits as 9 and runs of letters as a."""
    return _LETTERS.sub("a", _DIGITS.sub("9", text))


def registers(groups: list[list[str]]) -> np.ndarray:
    """Min-hash registers of sets of texts, none empty, one row a set; equal sets have equal registers. All sets are hashed together."""
    if not groups:
        return np.zeros((0, REGISTERS), np.int64)
    h = pd.util.hash_array(np.array([t for g in groups for t in g], dtype=object), categorize=False).astype(np.uint64)
    begin = np.concatenate(([0], np.cumsum([len(g) for g in groups])[:-1]))
    out = np.empty((len(groups), REGISTERS), np.int64)
    for k in range(REGISTERS):
        mixed = h ^ (np.uint64(k + 1) * np.uint64(0x9E3779B97F4A7C15))
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        out[:, k] = np.minimum.reduceat((mixed ^ (mixed >> np.uint64(32))) >> np.uint64(1), begin).astype(np.int64)
    return out
