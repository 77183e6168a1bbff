"""Fetchers of pages: from the web, and a local one for tests."""

from __future__ import annotations

import urllib.request

TIMEOUT_SECONDS = 10.0  # fixed: as the engine's callers expect


class WebFetcher:
    """Pages over http; urllib follows redirects."""

    def __init__(self, timeout: float = TIMEOUT_SECONDS):
        self.timeout = timeout

    def fetch(self, url: str) -> tuple[int, str]:
        with urllib.request.urlopen(url, timeout=self.timeout) as answer:  # noqa: S310
            return answer.status, answer.read().decode(answer.headers.get_content_charset() or "utf-8", "replace")


class StoredPages:
    """Pages by url from a dictionary: (status, body), or an exception to raise."""

    def __init__(self, pages: dict[str, tuple[int, str] | Exception]):
        self.pages = pages

    def fetch(self, url: str) -> tuple[int, str]:
        found = self.pages.get(url, (404, ""))
        if isinstance(found, Exception):
            raise found
        return found
