"""Settings of a run, from an ini file."""

from __future__ import annotations

import configparser
import json
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Settings:
    """What the jobs in ``plans.jobs`` need to know."""

    start_date: str = "2020-01-01"
    end_date: str = "TODAY"
    cloud_cover: int = 60
    tiles: tuple[str, ...] = ()
    from_classes: tuple[int, ...] = (1, 2, 3)
    to_classes: tuple[int, ...] = (4, 5, 6)
    hidden_classes: tuple[int, ...] = (0, 1, 2, 3, 8, 9, 10, 11)
    index_threshold: float = -0.2
    buffer_size: int = 0
    sieve: int = 0
    epoch: str = "2000-01-01"
    areas: tuple[str, ...] = ()
    least_area: float = 0.0
    other: dict = field(default_factory=dict, compare=False)


def read(path: str) -> Settings:
    """Sections are flattened; values are JSON where they can be, else text. Unknown names are kept in ``other``."""
    parser = configparser.ConfigParser(allow_no_value=True, interpolation=None)
    with open(path) as f:
        parser.read_file(f)
    values, other = {}, {}
    for section in parser.sections():
        for name, text in parser.items(section):
            try:
                value = json.loads(text) if text else None
            except ValueError:
                value = {"true": True, "false": False}.get(text.strip().lower(), text)
            value = tuple(value) if isinstance(value, list) else value
            (values if name in Settings.__dataclass_fields__ and name != "other" else other)[name] = value
    return Settings(**values, other=other)
