"""Custom format configurations from YAML files, read on the driver."""

from __future__ import annotations

from pathlib import Path

import yaml

from faultline.operators.custom import ParseError, ParserConfig


def load_config(path: str | Path) -> ParserConfig:
    try:
        data = yaml.safe_load(Path(path).read_text(encoding="utf-8"))
    except FileNotFoundError as error:
        raise ParseError(f"Config file not found: {path}") from error
    except yaml.YAMLError as error:
        raise ParseError(f"Invalid YAML: {error}") from error
    return ParserConfig.from_dict(data)


def load_configs(directory: str | Path) -> list[ParserConfig]:
    """All usable configurations of a folder: ``*.yaml`` first, then ``*.yml``, each by name.

    A folder that does not exist gives none; a file that cannot be used is left out.
    """
    configs = []
    for suffix in ("*.yaml", "*.yml"):
        for path in sorted(Path(directory).glob(suffix)):
            try:
                configs.append(load_config(path))
            except ParseError:
                continue
    return configs
