"""Hashes of contents and configurations."""

from __future__ import annotations

import base64
import hashlib
import json
import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_json(value) -> str:
    """JSON with sorted keys and no spaces; numbers that JSON lacks are an error."""

    def plain(v):
        if isinstance(v, float):
            if not math.isfinite(v):
                raise ValueError("configurations hold finite numbers only")
            return int(v) if v.is_integer() and abs(v) < 1e15 else v
        if isinstance(v, dict):
            return {str(k): plain(x) for k, x in v.items()}
        return [plain(x) for x in v] if isinstance(v, list | tuple) else v

    return json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def config_hash(value: dict) -> str:
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def request_hash(*fields: Column) -> Column:
    """Hash of a request's fields in a fixed order."""
    return F.sha2(F.to_json(F.struct(*fields)), 256)


def encode_cursor(**fields) -> str:
    """Opaque page cursor."""
    return base64.urlsafe_b64encode(canonical_json(fields).encode()).decode().rstrip("=")


def decode_cursor(cursor: str, names: set[str]) -> dict:
    """Fields of a cursor, which must be exactly those named."""
    try:
        got = json.loads(base64.b64decode(cursor + "=" * (-len(cursor) % 4), altchars=b"-_", validate=True))
    except Exception as e:
        raise ValueError("not a cursor") from e
    if not isinstance(got, dict) or set(got) != names:
        raise ValueError("not a cursor of this listing")
    return got
