"""Canonical JSON and signatures. Keys stay with the driver: no function here puts one into a table."""

from __future__ import annotations

import hashlib
import hmac
import json
import os
import secrets
from collections.abc import Iterable
from datetime import date, datetime

from pyspark.sql import Column, Row
from pyspark.sql import functions as F


def _plain(value, inside_array: bool = False):
    if isinstance(value, Row):
        value = value.asDict()
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items() if v is not None}
    if isinstance(value, (list, tuple)):
        return [_plain(v, True) for v in value]
    if isinstance(value, (datetime, date)):
        return value.isoformat()
    if isinstance(value, float) and value.is_integer():
        return int(value)
    return value


def canonical_json(value) -> str:
    """Keys sorted at every depth, no spaces; absent values left out of objects, null in arrays."""
    return json.dumps(_plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def receipt_key(environ=os.environ, default_file: str | None = None) -> tuple[str, str]:
    """(key, where it came from): the environment's, else the key file's, which is made with owner-only rights if absent."""
    if environ.get("RECEIPT_KEY"):
        return environ["RECEIPT_KEY"], "env:RECEIPT_KEY"
    file = environ.get("RECEIPT_KEYFILE") or default_file or os.path.expanduser("~/.sparkloom/receipt.key")
    if not os.path.exists(file):
        os.makedirs(os.path.dirname(file), exist_ok=True)
        with os.fdopen(os.open(file, os.O_WRONLY | os.O_CREAT | os.O_EXCL, 0o600), "w") as f:
            f.write(secrets.token_hex(32))
    with open(file, encoding="utf-8") as f:
        return f.read().strip(), file


def sign(value, key: str) -> str:
    return hmac.new(key.encode(), canonical_json(value).encode(), hashlib.sha256).hexdigest()


def verify(value, signature: str | None, key: str) -> bool:
    return hmac.compare_digest(sign(value, key).encode(), (signature or "").encode())


def sign_parts(parts: Iterable[str], key: str) -> str:
    """The signature of a text that comes in parts."""
    running = hmac.new(key.encode(), digestmod=hashlib.sha256)
    for part in parts:
        running.update(part.encode())
    return running.hexdigest()


def hmac_sha256(message: Column, key: str) -> Column:
    """The same signature over a text column, on SQL functions. The key is in the plan: use it where plans aren't kept."""
    raw = key.encode()
    raw = hashlib.sha256(raw).digest() if len(raw) > 64 else raw
    pads = [F.lit(bytes(b ^ x for b in raw.ljust(64, b"\0"))) for x in (0x36, 0x5C)]
    inner = F.unhex(F.sha2(F.concat(pads[0], F.encode(message, "UTF-8")), 256))
    return F.sha2(F.concat(pads[1], inner), 256)
