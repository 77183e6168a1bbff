"""Providers stand for the remote models and services: enrichment, intent, embedding, chat, and pages by url."""

from __future__ import annotations

from typing import Protocol


class Provider(Protocol):
    """Must be picklable. A provider with an ``open()`` method is opened once a partition; what that returns (a client, a
    cached context) answers all of its batches."""

    dimension: int

    def enrich(self, title: str, description: str) -> dict: ...

    def intent(self, query: str) -> dict: ...

    def embed(self, texts: list[str]) -> list[list[float]]: ...

    def chat(self, context: str, question: str) -> str: ...


class Fetcher(Protocol):
    """Gives status and body of a page, following redirects, within a time limit; may raise."""

    def fetch(self, url: str) -> tuple[int, str]: ...


def opened(provider):
    """What answers in this partition."""
    return provider.open() if hasattr(provider, "open") else provider


def enrich_batch(provider: Provider, notices: list[tuple[str, str]]) -> list[dict | Exception]:
    """An answer or the error for each (title, description): by the provider's ``enrich_many`` if it has one, else one by one."""
    if hasattr(provider, "enrich_many"):
        try:
            answers = list(provider.enrich_many(notices))
            if len(answers) != len(notices):
                raise ValueError(f"the provider gave {len(answers)} answers to {len(notices)} notices")
            return answers
        except Exception as e:
            return [e] * len(notices)
    out: list[dict | Exception] = []
    for title, description in notices:
        try:
            out.append(provider.enrich(title, description))
        except Exception as e:
            out.append(e)
    return out


def page_of(fetcher: Fetcher, url: str | None) -> str | None:
    """The body of an http page that is answered with status 200; else null, whatever goes wrong."""
    if not (url or "").startswith("http"):
        return None
    try:
        status, body = fetcher.fetch(url)
    except Exception:
        return None
    return body if status == 200 else None
