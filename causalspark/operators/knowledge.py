"""Background knowledge: tiers, forbidden and required edges."""

from __future__ import annotations

import fnmatch
import re
from dataclasses import dataclass, field


@dataclass
class Knowledge:
    """Edges that a search may not or must have. Names may hold `*` wildcards."""

    tiers: list[list[str]] = field(default_factory=list)
    forbidden_within: set[int] = field(default_factory=set)
    _forbidden: set[tuple[str, str]] = field(default_factory=set)
    _required: set[tuple[str, str]] = field(default_factory=set)

    def tier(self, v: str) -> int | None:
        return next((k for k, t in enumerate(self.tiers) if any(fnmatch.fnmatchcase(v, p) for p in t)), None)

    def forbid(self, a: str, b: str) -> Knowledge:
        self._forbidden.add((a, b))
        return self

    def require(self, a: str, b: str) -> Knowledge:
        self._required.add((a, b))
        return self

    def forbidden(self, a: str, b: str) -> bool:
        """Whether a --> b is excluded, by an edge, or because a's tier comes after b's."""
        if any(fnmatch.fnmatchcase(a, x) and fnmatch.fnmatchcase(b, y) for x, y in self._forbidden):
            return True
        s, t = self.tier(a), self.tier(b)
        return s is not None and t is not None and (s > t or s == t and s in self.forbidden_within)

    def required(self, a: str, b: str) -> bool:
        return any(fnmatch.fnmatchcase(a, x) and fnmatch.fnmatchcase(b, y) for x, y in self._required)

    def no_edge(self, a: str, b: str) -> bool:
        return self.forbidden(a, b) and self.forbidden(b, a)

    def may_condition(self, z: str, x: str, y: str) -> bool:
        """Whether z could be a cause of x or y, so that it may separate them."""
        return not (self.forbidden(z, x) and self.forbidden(z, y))

    @classmethod
    def parse(cls, text: str) -> Knowledge:
        """From the sections /knowledge, addtemporal, forbiddirect and requiredirect; `*` after a tier forbids edges within it."""
        k, mode = cls(), ""
        for line in (x.split("//")[0].strip() for x in text.splitlines()):
            if not line or line.lower() == "/knowledge":
                continue
            if line.lower() in ("addtemporal", "forbiddirect", "requiredirect", "forbidgroup", "requiregroup"):
                mode = line.lower()
                continue
            words = re.split(r"[\s,]+", line)
            if mode == "addtemporal":
                number = int(re.match(r"\d+", words[0])[0])
                at = number - 1 if number else 0
                while len(k.tiers) <= at:
                    k.tiers.append([])
                if "*" in words[0]:
                    k.forbidden_within.add(at)
                k.tiers[at] += words[1:]
            elif len(words) >= 2:
                (k.forbid if mode == "forbiddirect" else k.require)(words[0], words[1])
        return k

    def text(self) -> str:
        rows = ["/knowledge", "addtemporal", *(f"{i}{'*' if i - 1 in self.forbidden_within else ''} {' '.join(t)}" for i, t in enumerate(self.tiers, 1))]
        return "\n".join([*rows, "forbiddirect", *(" ".join(e) for e in sorted(self._forbidden)), "requiredirect", *(" ".join(e) for e in sorted(self._required))]) + "\n"
