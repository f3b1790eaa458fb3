"""Log lines and optional spans of plans; a tracer that fails never stops a plan."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager

log = logging.getLogger("sparkloom")


def configure(level: str = "INFO") -> None:
    logging.basicConfig(level=level, format="%(asctime)s %(levelname)s %(name)s %(message)s")


@contextmanager
def span(name: str, send: Callable[[dict], None] | None = None) -> Iterator[None]:
    """Times what is done in it; ``send`` gets name, seconds and error."""
    start, error = time.monotonic(), None
    try:
        yield
    except Exception as e:
        error = f"{type(e).__name__}: {e}"
        raise
    finally:
        took = {"name": name, "seconds": round(time.monotonic() - start, 3), "error": error}
        log.info("%(name)s took %(seconds)s s, error %(error)s", took)
        if send is not None:
            try:
                send(took)
            except Exception as e:  # noqa: BLE001 - tracing is optional
                log.warning("no trace of %s: %s", name, e)
