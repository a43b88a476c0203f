"""Keyed hashes: visitor ids, address hashes and pseudonym sources."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

VISITOR_ID = "^[0-9a-f]{16}$"
SESSION_ID = "^[0-9a-f-]{36}$"


def hmac_hex(secret: str, message: Column) -> Column:
    """HMAC-SHA256 as 64 hex digits, from two SHA-256 calls with constant pads."""
    key = secret.encode()
    if len(key) > 64:
        key = hashlib.sha256(key).digest()
    key = key.ljust(64, b"\0")
    inner_pad = F.unhex(F.lit(bytes(b ^ 0x36 for b in key).hex()))
    outer_pad = F.unhex(F.lit(bytes(b ^ 0x5C for b in key).hex()))
    inner = F.sha2(F.concat(inner_pad, message.cast("binary")), 256)
    return F.sha2(F.concat(outer_pad, F.unhex(inner)), 256)


def ip_hash(secret: str, ip: Column) -> Column:
    return hmac_hex(secret, ip)


def visitor_hash(secret: str, ip: Column, agent: Column, site: Column, day: Column) -> Column:
    """The same visitor on the same site and day keeps its id; other days differ."""
    text = F.concat_ws("|", ip, F.coalesce(agent, F.lit("")), site, day.cast("string"))
    return F.substring(hmac_hex(secret, text), 1, 16)


POSITIONS = 1024  # fixed: ids of rows written before stay apart from new ones


def event_number(sender: str, position: Column, *, api: bool) -> Column:
    """A number of each event's own, from that of its post or API batch and its place in
    it. An event beyond POSITIONS has none, which raises."""
    place = F.when(position < POSITIONS, position).otherwise(F.raise_error(F.lit(f"more than {POSITIONS} events in one post")))
    return (F.col(sender) * POSITIONS + place.cast("long")) * 2 + int(api)


def valid_cookie(cookie: Column) -> Column:
    return F.when(cookie.rlike(VISITOR_ID), cookie)


def valid_session(session: Column) -> Column:
    return F.when(session.rlike(SESSION_ID), session)
