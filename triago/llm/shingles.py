"""Words of a text and runs of them."""

from __future__ import annotations

SEED = 42


def shingles(parts: list[bytes], words: int) -> list[bytes]:
    """Runs of ``words`` words, repeats included; fewer words make one shingle, none none."""
    if len(parts) <= words:
        return [b" ".join(parts)] if parts else []
    return list(map(b" ".join, zip(*(parts[i:] for i in range(words)), strict=False)))


def split_words(text: str | None) -> list[bytes]:
    """Words of a whole text, A-Z lower-cased; as bytes, lower() and split() touch ASCII letters and spaces only."""
    return (text or "").encode().lower().split()
