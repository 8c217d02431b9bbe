"""Plain restatements of the corpus queries' contracts, row by row in Python."""

from __future__ import annotations

import hashlib
import re

ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)


def secrets(text: str | None) -> tuple[int, int, int, str]:
    text = text or ""
    spans = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    spans += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    joined = ",".join(f"{kind}:{start}:{end}" for start, _, kind, end in sorted(spans))
    return *(sum(s[2] == k for s in spans) for k in ("assign", "access", "hex")), hashlib.sha256(joined.encode()).hexdigest()
