"""Tokens in addresses, and messages without them."""

from __future__ import annotations

import re
from urllib.parse import urlsplit, urlunsplit


def with_token(url: str, token: str | None) -> str:
    """An https URL with the token as its user; other URLs unchanged."""
    parts = urlsplit(url)
    if not token or parts.scheme != "https" or not parts.hostname:
        return url
    host = parts.hostname + (f":{parts.port}" if parts.port else "")
    return urlunsplit(parts._replace(netloc=f"x-access-token:{token}@{host}"))


def mask_token(text: str, token: str | None) -> str:
    """A message without the token, and without any credentials in URLs."""
    out = text.replace(token, "***") if token else text
    return re.sub(r"(https?://)[^/@\s]+@", r"\1***@", out)
