"""Errors, events and event handlers."""

from __future__ import annotations

from collections.abc import Callable


class LinkedDataError(Exception):
    """An error with a name and, if the specification gives one, a code."""

    def __init__(self, message: str, name: str = "ld.SyntaxError", code: str | None = None, **details: object):
        super().__init__(message)
        self.name, self.code, self.details = name, code, details


def syntax(code: str, message: str | None = None, **details: object) -> LinkedDataError:
    return LinkedDataError(message or code, code=code, **details)


#: Event codes that safe mode refuses: data would be lost or changed. (Fixed values.)
UNSAFE = frozenset(
    [
        "blank node predicate", "empty object", "free-floating scalar", "invalid @language value", "invalid property", "null @id value", "null @value value",
        "object with only @id", "object with only @language", "object with only @list", "object with only @value", "rdfDirection not set",
        "relative @id reference", "relative @type reference", "relative @vocab reference", "relative graph reference", "relative object reference",
        "relative predicate reference", "relative subject reference", "reserved @id value", "reserved @reverse value", "reserved term",
    ]
)


class Events:
    """The events of one call, in order, sent through handlers: safe mode first, then the caller's.

    A handler is a function of (event, next), a list of handlers, or a dict from
    codes to functions; it calls next() to let later handlers see the event.
    """

    def __init__(self, safe: bool = False, handler: object = None):
        self.log: list[dict] = []
        self.safe, self.handler = safe, handler

    def emit(self, code: str, message: str = "", level: str = "warning", **details: object) -> None:
        self._send({"type": ["JsonLdEvent"], "code": code, "level": level, "message": message or code, "details": details})

    def resend(self, log: list[dict]) -> None:
        """Emit the events of another log."""
        for event in log:
            self._send({**event, "type": [*event["type"]], "details": {**event["details"]}})

    def _send(self, event: dict) -> None:
        self.log.append(event)
        code = event["code"]
        if self.safe and code in UNSAFE:
            raise LinkedDataError(f"safe mode: {code}", "ld.ValidationError", event=event)
        if self.handler is not None:
            _handle(event, self.handler)

    @property
    def codes(self) -> list[str]:
        return [e["code"] for e in self.log]


def _handle(event: dict, handler: object) -> bool:
    """Whether later handlers are to see the event."""
    if isinstance(handler, (list, tuple)):
        return all(_handle(event, h) for h in handler)
    if isinstance(handler, dict):
        return event["code"] not in handler or _handle(event, handler[event["code"]])
    if callable(handler):
        passed: list[bool] = []
        handler(event, lambda: passed.append(True))
        return bool(passed)
    raise LinkedDataError("an event handler is a function, list or dict", "ld.InvalidEventHandler")


def safe_handler(event: dict, next_: Callable[[], None]) -> None:
    if event["level"] == "warning" and event["code"] in UNSAFE:
        raise LinkedDataError(f"safe mode: {event['code']}", "ld.ValidationError", event=event)
    next_()


def strict_handler(event: dict, next_: Callable[[], None]) -> None:
    raise LinkedDataError(f"unhandled event: {event['code']}", "ld.UnhandledEvent", event=event)


def log_handler(event: dict, next_: Callable[[], None]) -> None:
    print(f"{event['level'].upper()}: {event['message']}")
    next_()
