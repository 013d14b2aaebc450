"""One line of comma-separated values, read strictly."""

from __future__ import annotations

import csv


def strip_end(line: str) -> str:
    """The line without one line end (a carriage return, a line feed or both)."""
    line = line[:-1] if line.endswith("\n") else line
    return line[:-1] if line.endswith("\r") else line


def cells(line: str) -> list[str] | None:
    """The cells of a line, or None if its quoting is not well-formed.

    Quotes enclose whole cells and a quote inside is doubled; ="x" means x. The line end must be gone.
    """
    if '"' not in line:
        return line.split(",")
    out: list[str] = []
    at, end = 0, len(line)
    while True:
        open_at = at + 1 if line.startswith('="', at) else at
        if line.startswith('"', open_at):
            text, look = [], open_at + 1
            while True:
                close = line.find('"', look)
                if close < 0:
                    return None
                text.append(line[look:close])
                if line.startswith('"', close + 1):
                    text.append('"')
                    look = close + 2
                    continue
                break
            out.append("".join(text))
            at = close + 1
            if at < end and line[at] != ",":
                return None
        else:
            stop = line.find(",", at)
            cell = line[at:] if stop < 0 else line[at:stop]
            if '"' in cell:
                return None
            out.append(cell)
            at = end if stop < 0 else stop
        if at >= end:
            return out
        at += 1
        if at == end:
            out.append("")
            return out


def lenient_cells(line: str) -> list[str]:
    """The cells of a line; where its quoting is not well-formed (as with blanks around quotes), as well as they can be told."""
    found = cells(line)
    if found is None:
        found = next(csv.reader([line], skipinitialspace=True), [""])
    return found
