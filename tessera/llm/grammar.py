"""Finite-state transducers over the symbols of a clause grammar, and their composition.

A transducer has a start state and arcs (state, input) -> (state, output). Composition feeds the outputs of one to the next: the composed machine's states
are pairs, and only what the start reaches is built. The grammar composes five transducers in this order:

- negation: marks insults and harm verbs within three words after a negation;
- reported speech: marks those inside quotation marks, and those after a reporting verb up to the end of its clause; a comma right after the verb and any
  colon do not end it;
- threat: an intent verb, a harm verb within three words, a target within three words after that;
- insult: turns insults into clause classes that need no target, and leaves the others open;
- target: an open insult is directed if a target stands within four words before or three words after it in its clause, else plain.

Words and marks are read by their symbols, so the machines are small and the same for every lexicon.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Hashable, Iterable
from dataclasses import dataclass

SYMBOLS = ("word", "insult", "harm", "intent", "target", "negation", "report", "quote", "comma", "colon", "stop")
BREAKS = ("comma", "colon", "stop")
CLASSES = ("directed", "plain", "negated", "reported", "threat")
#: Words after a negation, after an intent verb, from a harm verb to its target, before an insult and after it, and from a reporting verb to its comma.
NEGATED, INTENDED, AIMED, BEFORE, AFTER, SAID = 3, 3, 3, 4, 3, 2


@dataclass
class Transducer:
    """Arcs by state and input; outputs are any values, the next machine's inputs."""

    start: Hashable
    arcs: dict[tuple[Hashable, Hashable], tuple[Hashable, Hashable]]

    @classmethod
    def of(cls, start: Hashable, inputs: Iterable[Hashable], step: Callable) -> Transducer:
        """The arcs that start reaches by step(state, input) -> (state, output)."""
        inputs, arcs, todo, seen = list(inputs), {}, [start], {start}
        while todo:
            state = todo.pop()
            for a in inputs:
                arcs[state, a] = after, _ = step(state, a)
                if after not in seen:
                    seen.add(after)
                    todo.append(after)
        return cls(start, arcs)

    @property
    def outputs(self) -> list[Hashable]:
        return sorted({out for _, out in self.arcs.values()}, key=repr)

    def then(self, other: Transducer) -> Transducer:
        """The composition: other reads what this machine writes."""
        inputs = {a for _, a in self.arcs}

        def step(state, a):
            p, q = state
            p, b = self.arcs[p, a]
            q, c = other.arcs[q, b]
            return (p, q), c

        return Transducer.of((self.start, other.start), sorted(inputs, key=repr), step)


def negation(state: int, a: str):
    """state: words left in the scope of a negation."""
    if a in BREAKS:
        return 0, a
    if a == "quote":
        return state, a
    out = f"{a}/negated" if state and a in ("insult", "harm") else a
    return (NEGATED if a == "negation" else max(0, state - 1)), out


def reported(state: tuple[int, int, bool], a: str):
    """state: words left in which a comma belongs to the verb, whether its speech goes on, inside quotation marks."""
    fresh, on, quoted = state
    if a == "stop":
        return (0, 0, quoted), a
    if a == "comma":
        return (0, int(on and fresh > 0), quoted), a
    if a == "colon":
        return (0, on, quoted), a
    if a == "quote":
        return (0, on, not quoted), a
    if a == "report":
        return (SAID, 1, quoted), a
    kind = a.split("/")[0]
    out = f"{kind}/reported" if (on or quoted) and kind in ("insult", "harm") else a
    return (max(0, fresh - 1), on, quoted), out


def threat(state: tuple[int, int, str], a: str):
    """state: words left after an intent verb, after a harm verb, and the class that its target gives. Writes (symbol, class or none)."""
    intent, aim, kind = state
    if a in BREAKS:
        return (0, 0, ""), (a, None)
    if a == "quote":
        return state, (a, None)
    found = kind if aim and a == "target" else None
    if a in ("harm", "harm/reported") and intent:
        aim, kind = AIMED, "threat" if a == "harm" else "reported"
    else:
        aim = 0 if found else max(0, aim - 1)
    return (INTENDED if a == "intent" else max(0, intent - 1), aim, kind if aim else ""), (a, found)


def insult(state: int, a: tuple[str, str | None]):
    """Writes (open insult, target, break or other; classes that are settled)."""
    symbol, found = a
    kind = {"insult/negated": "negated", "insult/reported": "reported"}.get(symbol)
    role = symbol if symbol in ("insult", "target", "quote") else "break" if symbol in BREAKS else "word"
    return 0, (role, tuple(x for x in (found, kind) if x))


def target(state: tuple[int, tuple[int, ...]], a: tuple[str, tuple[str, ...]]):
    """state: words left after a target, and for each open insult the words left in which a target may follow. Writes the classes that are settled."""
    near, waiting = state
    role, settled = a
    out = list(settled)
    if role == "break":
        return (0, ()), (*out, *("plain" for _ in waiting))
    if role == "quote":
        return state, tuple(out)
    if role == "target":
        return (BEFORE, ()), (*out, *("directed" for _ in waiting))
    out += ["plain" for w in waiting if w == 1]
    waiting = tuple(w - 1 for w in waiting if w > 1)
    if role == "insult" and near:
        out.append("directed")
    elif role == "insult":
        waiting += (AFTER,)
    return (max(0, near - 1), waiting), tuple(out)


def compose() -> Transducer:
    machine = Transducer.of(0, SYMBOLS, negation)
    for start, step in (((0, 0, False), reported), ((0, 0, ""), threat), (0, insult), ((0, ()), target)):
        machine = machine.then(Transducer.of(start, machine.outputs, step))
    return machine


class Grammar:
    """The composed machine with numbered states: a row of (next state, classes) for each state."""

    def __init__(self):
        machine = compose()
        number: dict = {}
        for state, _ in machine.arcs:
            number.setdefault(state, len(number))
        self.start, self.rows = number[machine.start], [{} for _ in number]
        for (state, a), (after, out) in machine.arcs.items():
            self.rows[number[state]][a] = number[after], out

    def classes(self, symbols: Iterable[str]) -> Counter:
        """How often each clause class is matched; the end of the symbols ends a sentence."""
        found: Counter = Counter()
        state = self.start
        for a in (*symbols, "stop"):
            state, out = self.rows[state][a]
            if out:
                found.update(out)
        return found
