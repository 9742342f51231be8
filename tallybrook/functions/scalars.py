"""Scalar rules: category, severity, client address, validation."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Event types of each category; any other type is "other".
CATEGORIES = {
    "engagement": ["page_view", "click", "scroll", "hover"],
    "commerce": ["purchase", "add_to_cart", "remove_from_cart", "checkout"],
    "auth": ["login", "logout", "signup", "password_reset"],
    "discovery": ["search", "filter", "sort"],
    "error": ["error", "crash", "timeout"],
}

# Length limits of the request fields.
MAX_EVENT_TYPE = 50
MAX_USER_ID = 100


def category(event_type: str | Column) -> Column:
    """Category of a type in any case; a lookup in a constant map, so one ``lower``."""
    pairs = [F.lit(v) for label, types in CATEGORIES.items() for t in types for v in (t, label)]
    event_type = F.col(event_type) if isinstance(event_type, str) else event_type
    found = F.coalesce(F.element_at(F.create_map(*pairs), F.lower(event_type)), F.lit("other"))
    return F.when(event_type.isNotNull(), found)


def severity(abs_z: str | Column) -> Column:
    z = F.col(abs_z) if isinstance(abs_z, str) else abs_z
    return F.when(z > 5.0, "HIGH").when(z > 3.0, "MEDIUM").otherwise("LOW")


def client_ip(forwarded_for: str | Column, remote_addr: str | Column) -> Column:
    """First forwarded address without characters up to U+0020 around it; the remote address when there is none."""
    first = F.regexp_replace(F.split(forwarded_for, ",")[0], r"^[\x00-\x20]+|[\x00-\x20]+$", "")
    remote = F.col(remote_addr) if isinstance(remote_addr, str) else remote_addr
    return F.when(F.length(first) > 0, first).otherwise(remote)


def not_blank(text: str | Column) -> Column:
    """True when some character lies above U+0020; null counts as blank."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(text.rlike(r"[^\x00-\x20]"), F.lit(False))


def violations(event_type: str | Column = "event_type", user_id: str | Column = "user_id",
               payload: str | Column = "payload", prefix: Column | None = None) -> Column:
    """Array of ``field: message``, in field order; empty for a valid request.

    A ``prefix`` is set before each field, as for the elements of a batch.
    """
    payload = F.col(payload) if isinstance(payload, str) else payload
    # The message texts.
    checks = [
        (~not_blank(event_type), "eventType: eventType is required"),
        (F.char_length(event_type) > MAX_EVENT_TYPE,
         "eventType: eventType must be under 50 characters"),
        (~not_blank(user_id), "userId: userId is required"),
        (F.char_length(user_id) > MAX_USER_ID,
         "userId: userId must be under 100 characters"),
        (payload.isNull(), "payload: payload is required"),
    ]

    def said(text: str) -> Column:
        return F.lit(text) if prefix is None else F.concat(prefix, F.lit(text))

    return F.array_compact(F.array(*[F.when(bad, said(text)) for bad, text in checks]))


def is_valid(event_type: str = "event_type", user_id: str = "user_id",
             payload: str = "payload") -> Column:
    return (not_blank(event_type) & (F.char_length(event_type) <= MAX_EVENT_TYPE)
            & not_blank(user_id) & (F.char_length(user_id) <= MAX_USER_ID)
            & F.col(payload).isNotNull())


def threshold_status(value: str | Column, warn: int, alarm: int,
                     warn_name: str = "yellow", alarm_name: str = "red") -> Column:
    value = F.col(value) if isinstance(value, str) else value
    return (F.when(value >= alarm, alarm_name).when(value >= warn, warn_name)
            .otherwise("green"))
