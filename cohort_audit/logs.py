"""Logging of the package."""

from __future__ import annotations

import logging

NAME = "cohort_audit"


def get_logger(name: str | None = None) -> logging.Logger:
    return logging.getLogger(NAME if not name or name == NAME else name if name.startswith(f"{NAME}.") else f"{NAME}.{name}")


def configure_logging(level: int = logging.INFO, format_string: str | None = None, stream: bool = True, filename: str | None = None) -> logging.Logger:
    log = get_logger()
    log.handlers.clear()
    form = logging.Formatter(format_string or "%(asctime)s %(name)s %(levelname)s %(message)s")
    for handler in ([logging.StreamHandler()] if stream else []) + ([logging.FileHandler(filename)] if filename else []):
        handler.setFormatter(form)
        log.addHandler(handler)
    log.setLevel(level)
    return log


def set_log_level(level: int | str) -> None:
    get_logger().setLevel(level.upper() if isinstance(level, str) else level)


def disable_logging() -> None:
    get_logger().disabled = True


def enable_logging() -> None:
    get_logger().disabled = False
