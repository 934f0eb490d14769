"""Lexicons and valence shifters: validated, immutable, small."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass

Pairs = Iterable[tuple[str, float]]


def as_key(pairs: Pairs) -> dict[str, float]:
    """A lexicon in order of its lower-cased words.

    All copies of a word that occurs twice are dropped.  Copies are told before lower-casing, so that words that
    differ only in case both pass; the later one then counts.
    """
    rows = [(str(x), float(y)) for x, y in pairs]
    seen: dict[str, int] = {}
    for x, _ in rows:
        seen[x] = seen.get(x, 0) + 1
    twice = {x for x, n in seen.items() if n > 1}
    kept = [(x.lower(), y) for x, y in rows if x.lower() not in twice]
    return dict(sorted(kept, key=lambda r: r[0]))


@dataclass(frozen=True)
class Valence:
    """Shifters of one kind: ``y`` multiplies the next word's score, ``t`` is a type (1 negator, 2 amplifier, 3 deamplifier, 4 adversative)."""

    kind: str
    values: tuple[tuple[str, float], ...]


def valence(rows: Iterable[Mapping[str, object]], columns: Sequence[str] | None = None) -> Valence:
    """From rows with x and y or t.  With all three, the first two columns count; of repeated words the first; phrases go."""
    rows = list(rows)
    cols = list(columns or (rows[0] if rows else ("x", "y")))
    if not set(cols) <= {"x", "y", "t"} or len(cols) not in (2, 3) or "x" not in cols:
        raise ValueError("give the columns 'x' and 'y' and/or 't' for valence shifters")
    kind = next(c for c in cols[:2] if c != "x")
    if kind == "t" and not {float(r["t"]) for r in rows} <= {1.0, 2.0, 3.0, 4.0}:  # type: ignore[arg-type]
        raise ValueError("types of valence shifters are 1, 2, 3 and 4")
    out: dict[str, float] = {}
    for r in rows:
        x = str(r["x"]).lower()
        if not re.search(r"\s", x):
            out.setdefault(x, float(r[kind]))  # type: ignore[arg-type]
    return Valence(kind, tuple(out.items()))


class Lexicons(Mapping):
    """Named lexicons with optional valence shifters.  Items can't be replaced; ``[[names]]`` gives a part."""

    def __init__(self, lexicons: Mapping[str, Pairs | Mapping[str, float]], shifters: Valence | Iterable[Mapping[str, object]] | None = None, split: bool = False, _ready: bool = False) -> None:
        if not isinstance(lexicons, Mapping) or not lexicons:
            raise ValueError("lexicons must be a mapping of names with at least one lexicon")
        if any(not k or "-" in str(k) for k in lexicons):
            raise ValueError("names of lexicons must not be empty or contain '-'")
        made = dict(lexicons) if _ready else {k: as_key(v.items() if isinstance(v, Mapping) else v) for k, v in lexicons.items()}
        if split:
            made = {f"{k}_POS": {x: y for x, y in v.items() if y > 0} for k, v in made.items()} | {f"{k}_NEG": {x: y for x, y in v.items() if y < 0} for k, v in made.items()}
        self._lexicons = {k: {x: y for x, y in v.items() if not re.search(r"\s", x)} for k, v in made.items()}
        self.valence = shifters if isinstance(shifters, Valence) or shifters is None else valence(shifters)

    def __getitem__(self, key):  # noqa: ANN001, ANN204
        if isinstance(key, str):
            return dict(self._lexicons[key])
        names = [list(self._lexicons)[k] if isinstance(k, int) else k for k in key]
        if not names or any(n not in self._lexicons for n in names):
            raise KeyError("out of bounds; at least one lexicon must stay")
        return Lexicons({n: self._lexicons[n] for n in names}, self.valence, _ready=True)

    def __iter__(self) -> Iterator[str]:
        return iter(self._lexicons)

    def __len__(self) -> int:
        return len(self._lexicons)

    def renamed(self, names: Sequence[str]) -> Lexicons:
        if len(set(names)) < len(names) or len(names) != len(self):
            raise ValueError("give one name for each lexicon, none twice")
        return Lexicons(dict(zip(names, self._lexicons.values())), self.valence, _ready=True)

    @property
    def kind(self) -> str | None:
        """None without shifters, 'y' (previous word) or 't' (clusters)."""
        return self.valence.kind if self.valence else None

    def word_map(self) -> dict[str, list[float]]:
        """Scores of each word of any lexicon, 0 where a lexicon lacks it."""
        words = sorted({x for v in self._lexicons.values() for x in v})
        return {x: [v.get(x, 0.0) for v in self._lexicons.values()] for x in words}
