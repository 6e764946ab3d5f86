"""A parser of rules with loops, choices, escapes and actions, by backtracking over a replayable stream.

A rule tries its alternatives in order and gives up a choice when what follows it fails. ``find`` scans a text for all places where a
rule matches, without overlap.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from typing import Any


class Replay:
    """A stream that can go back to any place it has been at; what lies before the oldest mark is forgotten."""

    def __init__(self, items: Iterable[Any]) -> None:
        self._source, self._kept, self._base, self.at = iter(items), [], 0, 0

    def __iter__(self) -> Replay:
        return self

    def __next__(self) -> Any:
        place = self.at - self._base
        if place == len(self._kept):
            self._kept.append(next(self._source))
        self.at += 1
        return self._kept[place]

    def back(self, mark: int) -> None:
        if mark < self._base or mark > self.at:
            raise ValueError(f"cannot go back to {mark}")
        self.at = mark

    def forget(self, mark: int) -> None:
        """Nobody will go back before this place."""
        self._kept, self._base = self._kept[mark - self._base :], mark


#: A state is (place, values by name, bytes of the last match); matching yields every way to go on.
State = tuple[int, dict[str, Any], str]


@dataclass(frozen=True)
class Rule:
    match: Callable[[str, int], Iterator[State]]

    def __or__(self, other: Rule) -> Rule:
        def go(text: str, at: int) -> Iterator[State]:
            yield from self.match(text, at)
            yield from other.match(text, at)

        return Rule(go)

    def __rshift__(self, other: Rule) -> Rule:
        def go(text: str, at: int) -> Iterator[State]:
            for end, seen, got in self.match(text, at):
                for stop, more, rest in other.match(text, end):
                    yield stop, seen | more, got + rest

        return Rule(go)

    def many(self, least: int = 0) -> Rule:
        """As often as possible, and less often if what follows asks for it."""

        def go(text: str, at: int) -> Iterator[State]:
            stack: list[tuple[Iterator[State], State]] = []
            state: State = (at, {}, "")
            ways = self.match(text, at)
            while True:
                step = next(ways, None)
                if step is not None and step[0] > state[0]:
                    stack.append((ways, state))
                    state = (step[0], state[1] | step[1], state[2] + step[2])
                    ways = self.match(text, state[0])
                elif step is None:
                    if len(stack) >= least:
                        yield state
                    if not stack:
                        return
                    ways, state = stack.pop()

        return Rule(go)

    def named(self, name: str) -> Rule:
        return Rule(lambda text, at: ((end, seen | {name: got}, got) for end, seen, got in self.match(text, at)))

    def to(self, render: Callable[[str], Any], name: str = "value") -> Rule:
        """What the match becomes."""
        return Rule(lambda text, at: ((end, seen | {name: render(got)}, got) for end, seen, got in self.match(text, at)))

    def parse(self, text: str) -> dict[str, Any] | None:
        """Values of the first way to match the whole text."""
        return next((seen for end, seen, _ in self.match(text, 0) if end == len(text)), None)

    def find(self, text: str) -> list[dict[str, Any]]:
        return [seen for _, _, seen in self.spans(text)]

    def spans(self, text: str) -> list[tuple[int, int, dict[str, Any]]]:
        out, at = [], 0
        while at <= len(text):
            hit = next(self.match(text, at), None)
            if hit is None or hit[0] == at:
                at += 1
                continue
            out.append((at, hit[0], hit[1]))
            at = hit[0]
        return out

    def replace(self, text: str, render: Callable[[dict[str, Any]], str]) -> str:
        parts, last = [], 0
        for a, b, seen in self.spans(text):
            parts += [text[last:a], render(seen)]
            last = b
        return "".join([*parts, text[last:]])


def literal(text: str) -> Rule:
    return Rule(lambda t, at: iter([(at + len(text), {}, text)] if t.startswith(text, at) else []))


def one_of(chars: str, but: bool = False) -> Rule:
    """A character of a set, or (``but``) any other."""
    return Rule(lambda t, at: iter([(at + 1, {}, t[at])] if at < len(t) and (t[at] in chars) != but else []))


END = Rule(lambda t, at: iter([(at, {}, "")] if at == len(t) else []))


def until(stop: str, escape: str | None = None) -> Rule:
    """Everything before a character; an escaped one doesn't stop it."""
    plain = one_of(stop + (escape or ""), but=True)
    return (plain if escape is None else plain | (literal(escape) >> one_of("", but=True))).many()
