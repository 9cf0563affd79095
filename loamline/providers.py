"""Outside services as interfaces, with deterministic stand-ins that need no network."""

from __future__ import annotations

import hashlib
import math
import re
from typing import Protocol


class Embedder(Protocol):
    identity: str
    dimension: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class Judge(Protocol):
    def judge(self, candidates: list[dict]) -> list[dict]: ...


class HashEmbedder:
    """Words hashed into 64 signed places, of length one."""

    dimension = 64
    identity = "local:hash64:v1"

    def embed(self, texts: list[str]) -> list[list[float]]:
        return [self._one(t) for t in texts]

    def _one(self, text: str) -> list[float]:
        v = [0.0] * self.dimension
        for w in re.findall(r"\w+", text.lower()):
            h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
            v[h % self.dimension] += 1.0 if h >> 63 else -1.0
        n = math.sqrt(sum(x * x for x in v))
        return [x / n for x in v] if n else v


class RuleJudge:
    """Certain candidates are reported, contextual ones suppressed."""

    def judge(self, candidates: list[dict]) -> list[dict]:
        return [{"id": c["id"], "verdict": "report" if c["confidence"] == "certain" else "suppress", "reason": c["evidence"]} for c in candidates]


def identity(kind: str, model: str, version: str) -> str:
    """``local:`` or ``api:`` with model and version: part of an index's key."""
    return f"{kind}:{model}:{version}"
