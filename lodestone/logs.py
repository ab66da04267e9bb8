"""What the engine logs, by the logger named lodestone: errors, warnings, infos, and debug lines only if
they are wanted."""

from __future__ import annotations

import logging

from .schema import Config

log = logging.getLogger("lodestone")


def configure(config: Config = Config(), handler: logging.Handler | None = None) -> logging.Logger:
    """Sets the level that the configuration asks for; a handler, standard error by default, is added once."""
    log.setLevel(logging.DEBUG if config.debug_logging else logging.INFO)
    if not log.handlers:
        handler = handler or logging.StreamHandler()
        handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(message)s"))
        log.addHandler(handler)
    return log
