"""Settings from the environment and a file of the same names."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields
from pathlib import Path

PREFIX = "LOOMGRAPH_"


@dataclass(frozen=True)
class Settings:
    """What the command line needs to know beside its arguments; each field is the variable PREFIX + its name in capitals."""

    workspace: str = ".loomgraph"
    master: str = "local[*]"
    output: str = "output"
    model: str = ""
    reasoning_effort: str = "medium"
    max_chars: int = 60_000
    max_units: int = 30
    max_prompt_chars: int = 180_000
    max_output_tokens: int = 4_000


def load(env_file: str = ".env") -> Settings:
    """The environment's values go before those of the file, lines of NAME=value; others keep their defaults."""
    found: dict[str, str] = {}
    if Path(env_file).is_file():
        for line in Path(env_file).read_text(encoding="utf-8").splitlines():
            name, equals, value = line.strip().partition("=")
            if equals and not name.startswith("#"):
                found[name.strip().removeprefix("export ").strip().upper()] = value.strip().strip("\"'")
    found |= {k.upper(): v for k, v in os.environ.items()}
    given = {}
    for f in fields(Settings):
        if (value := found.get(PREFIX + f.name.upper())) is not None:
            try:
                given[f.name] = type(f.default)(value)
            except ValueError as error:
                raise ValueError(f"{PREFIX}{f.name.upper()} is not a number: {value}") from error
    return Settings(**given)
