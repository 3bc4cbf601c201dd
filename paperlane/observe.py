"""A log of steps that names counts and structure, never the content of cells or where files lie."""

from __future__ import annotations

import logging
import re

from paperlane.errors import Configuration


def get_logger(name: str) -> logging.Logger:
    return logging.getLogger(f"paperlane.{name}")


def assert_safe(fields: dict[str, object]) -> None:
    """Refuse fields that could carry content: long texts and absolute paths."""
    for name, value in fields.items():
        if isinstance(value, str) and (len(value) > 120 or "\n" in value or re.match(r"^(/|[A-Za-z]:[\\/]|\\\\|file:)", value)):
            raise Configuration(f"{name} isn't safe to log")


def log_step(logger: logging.Logger, step: str, **fields: object) -> None:
    if logger.isEnabledFor(logging.INFO):
        assert_safe(fields)
        logger.info("%s %s", step, " ".join(f"{k}={v}" for k, v in sorted(fields.items())))
