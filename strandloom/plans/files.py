"""Small files written by the driver: portfolio pages and stubs of concepts."""

from __future__ import annotations

import hashlib
from pathlib import Path



def portfolio_markdown(seats: list[dict]) -> str:
    """Seats of one query, in order, as a page."""
    lines = []
    for s in sorted(seats, key=lambda x: x["seat"]):
        lines += [f"## {s['seat'] + 1}. {s['id']}", "", str(s.get("excerpt", "")).strip(), ""]
    return "\n".join(lines).rstrip() + "\n" if lines else ""


def write_if_changed(path: str, text: str) -> bool:
    """Write a page unless the file holds it already; whether it was written."""
    p = Path(path)
    if p.exists() and hashlib.sha256(p.read_bytes()).digest() == hashlib.sha256(text.encode()).digest():
        return False
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_text(text)
    return True


def crystallize(root: str, kind: str, handle: str, summary: str) -> Path:
    """A stub page of a concept; an existing file is never overwritten."""
    path = Path(root) / kind / f"{handle}.md"
    path.parent.mkdir(parents=True, exist_ok=True)
    with path.open("x") as f:
        f.write(f"---\nhandle: {handle}\nkind: {kind}\nstatus: proposed\n---\n\n# {handle.replace('-', ' ').title()}\n\n{summary.strip()}\n")
    return path
