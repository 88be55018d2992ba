"""Sections of settings from INI text."""

from __future__ import annotations

import configparser


def sections(text: str) -> dict[str, dict[str, str]]:
    """section -> key -> value; keys keep their case, values are not interpolated; a broken line raises ValueError."""
    parser = configparser.ConfigParser(interpolation=None, strict=False)
    parser.optionxform = str
    try:
        parser.read_string(text)
    except configparser.Error as e:
        raise ValueError(str(e)) from e
    return {s: dict(parser.items(s)) for s in parser.sections()}
