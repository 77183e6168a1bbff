"""A deterministic provider without network: rules for enrichment and intent, hashed words for embeddings."""

from __future__ import annotations

import functools
import hashlib
import math
import re

import numpy as np

from noticeflow.schemas import DOMAINS

# Words that point to a domain, in the order in which domains are tried; expansions; type words.
DOMAIN_WORDS = {
    "Agriculture": ("agricultur", "farm", "crop", "irrigation", "livestock", "ear tag", "seed"),
    "Healthcare": ("hospital", "medical", "clinic", "health", "mri", "pharma", "surgical"),
    "Infrastructure": ("construction", "building", "road", "bridge", "civil", "housing", "sewer"),
    "Energy": ("power", "solar", "generator", "energy", "transformer", "electric"),
    "Defense": ("defense", "defence", "army", "military", "radio batter", "ammunition"),
    "Technology": ("software", "computer", "laptop", "server", "drone", "network", "website"),
    "Transport": ("vehicle", "transport", "railway", "bus ", "airport", "port "),
}
EXPANSIONS = {
    "hospital": ("Clinic", "Nursing Home", "Dispensary", "Medical Center", "Healthcare Facility"),
    "road": ("Highway", "Pavement", "Driveway", "Street", "Asphalt"),
    "school": ("College", "University", "Classroom", "Educational Institute"),
}
TYPE_WORDS = (("Services", ("consult", "hiring", "service", "maintenance")), ("Works", ("construction", "work", "build", "repair", "road")), ("Supply", ("purchase", "supply", "delivery", "procure", "equipment")))
BROAD_WORDS = ("drone", "computer", "security guard", "vehicle", "laptop")
WORD = re.compile(r"\w+")


class _Slots(dict):
    """Of each word the place that it counts at: below the dimension for it, above against it. Words are hashed once a process."""

    def __init__(self, dimension: int, most: int = 1 << 17):
        super().__init__()
        self.dimension, self.most = dimension, most

    def __missing__(self, word: str) -> int:
        if len(self) >= self.most:
            self.clear()
        h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "big")
        self[word] = slot = h % self.dimension + (0 if h >> 63 else self.dimension)
        return slot


@functools.lru_cache(maxsize=4)
def _slots(dimension: int) -> _Slots:
    return _Slots(dimension)


class LocalProvider:
    def __init__(self, dimension: int = 64, tags: tuple[str, ...] = (), summary_words: int | None = 10):
        """summary_words: of the title, how many a summary has; None for the title as it is."""
        self.dimension, self.tags, self.summary_words = dimension, tags, summary_words

    def _domains(self, text: str) -> list[str]:
        if "construction" in text and "hospital" in text:
            return ["Infrastructure", "Healthcare"]
        return [d for d, words in DOMAIN_WORDS.items() if any(w in text for w in words)]

    def enrich(self, title: str, description: str) -> dict:
        text = f"{title} {description}".lower()
        kind = next((k for k, words in TYPE_WORDS if any(w in text for w in words)), "Supply")
        return {
            "core_domain": next(iter(self._domains(text)), DOMAINS[-1]),
            "project_tags": [t for t in self.tags if t.lower() in text][:3],
            "procurement_type": kind,
            "search_keywords": [x for word, more in EXPANSIONS.items() if word in text for x in more],
            "entities": {"authority_name": "Unknown", "location_city": None, "location_state": None},
            "signal_summary": title if self.summary_words is None else " ".join(title.split()[: self.summary_words]),
        }

    def intent(self, query: str) -> dict:
        low = query.lower()
        return {"core_domains": self._domains(low), "procurement_types": [k for k, words in TYPE_WORDS if any(w in low for w in words)], "refined_query": query.strip(), "is_broad_query": any(w in low for w in BROAD_WORDS)}

    def embed(self, texts: list[str]) -> list[list[float]]:
        slots, n = _slots(self.dimension), self.dimension
        out = []
        for text in texts:
            counts = np.bincount(np.array([slots[w] for w in WORD.findall((text or "").lower())], np.int64), minlength=2 * n)
            v = (counts[:n] - counts[n:]).astype(float)
            size = math.sqrt(float(v @ v))
            out.append((v / size if size else v).tolist())
        return out

    def chat(self, context: str, question: str) -> str:
        """The line of the context that shares most words with the question."""
        asked = set(WORD.findall(question.lower()))
        best = max(context.split("\n"), key=lambda line: len(asked & set(WORD.findall(line.lower()))), default="")
        return best if asked & set(WORD.findall(best.lower())) else "I don't see that detail in the summary."
