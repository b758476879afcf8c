"""Settings: environment over file over default, with bounds (S19), and their fingerprint."""

from __future__ import annotations

import hashlib
import os
from dataclasses import asdict, dataclass, fields
from typing import ClassVar


@dataclass(frozen=True)
class Settings:
    candidate_limit: int = 100
    least_score: float = 0.35
    final_top_k: int = 10
    segment_length: float = 2.0
    segment_stride: float = 1.0
    vram_cap_gb: float = 8.0
    embedding_size: int = 2048
    extensions: str = ".mp4,.mkv,.mov,.avi,.webm,.m4v,.wmv,.flv"
    include_hidden: bool = False

    #: least and most of what has bounds
    BOUNDS: ClassVar[dict] = {"candidate_limit": (1, 500), "least_score": (0.0, 1.0), "final_top_k": (1, 500), "segment_length": (0.25, 30.0), "segment_stride": (0.25, 30.0)}

    @classmethod
    def load(cls, file: dict | None = None, environ: dict | None = None, prefix: str = "QUILLWORK_") -> Settings:
        """A value that can't be read is the next layer's; one out of bounds is the bound."""
        environ = os.environ if environ is None else environ
        out = {}
        for f in fields(cls):
            for raw in (environ.get(prefix + f.name.upper()), (file or {}).get(f.name)):
                value = _read(raw, type(f.default))
                if value is not None:
                    low, high = cls.BOUNDS.get(f.name, (value, value))
                    out[f.name] = min(high, max(low, value))
                    break
        return cls(**out)

    def fingerprint(self) -> str:
        return hashlib.sha256(repr(sorted(asdict(self).items())).encode()).hexdigest()[:16]


def _read(raw, kind: type):
    if raw is None:
        return None
    try:
        if kind is bool:
            return raw if isinstance(raw, bool) else {"1": True, "true": True, "yes": True, "on": True, "0": False, "false": False, "no": False, "off": False}[str(raw).strip().lower()]
        return kind(raw)
    except (KeyError, TypeError, ValueError):
        return None
