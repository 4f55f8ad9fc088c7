"""Least-cost repair of a sequence of symbols by a generalised LR parser.

The automaton is made from the grammar's rules. The parser keeps all stacks that edits of
the rows so far can lead to, as nodes that share what lies below them. Every row may be
kept, rerolled to another symbol or deleted, and symbols may be inserted before it. All
reductions are followed, without lookahead. Where two ways lead to equal stack tops on
equal stacks, the one with the smaller (cost, audit) stays; the audit is the initials of
the edits in order.

An audit fixes its cost, since an edit's cost depends on its row and initial alone. So of
two ways of equal cost neither audit is the beginning of the other before the last row's
edit, and to compare longer audits it is enough to know the order of the shorter ones. The
parser therefore keeps a rank for each stack in place of its audit. Costs beyond the least
one and ranks are few; what a row does to such a set of stacks is worked out once and then
looked up.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"

Rule = tuple[str, tuple[str, ...]]
#: A row's symbol, what it costs unless it is deleted, and whether it has to be.
Kind = tuple[str, int, bool]


@dataclass(frozen=True)
class Costs:
    keep: int = 0
    rerole: int = 1
    delete: int = 2
    insert: int = 5
    #: Beyond the least cost by more than this, a stack can't win any more: by the role
    #: grammar every stack can go on like any other with two inserts and a delete.
    margin: int = 12


class Automaton:
    """States of LR items with their moves and reductions."""

    def __init__(self, rules: list[Rule]) -> None:
        self.rules = [("", (rules[0][0],)), *rules]
        self.sets: list[frozenset] = []
        self.goto: dict[tuple[int, str], int] = {}
        #: For each state, what can be reduced there: head and length.
        self.reductions: list[list[tuple[str, int]]] = []
        self._state(frozenset([(0, 0)]))
        self.accepting = self.goto[0, rules[0][0]]
        # Only stacks that can grow, or are the answer, need to be kept.
        heads = {head for head, _ in self.rules}
        self.growing = {state for state, symbol in self.goto if symbol not in heads}

    def _state(self, kernel: frozenset) -> int:
        items, new = set(kernel), list(kernel)
        while new:
            rule, dot = new.pop()
            body = self.rules[rule][1]
            for other, (head, _) in enumerate(self.rules):
                if dot < len(body) and head == body[dot] and (other, 0) not in items:
                    items.add((other, 0))
                    new.append((other, 0))
        whole = frozenset(items)
        if whole in self.sets:
            return self.sets.index(whole)
        number = len(self.sets)
        self.sets.append(whole)
        done = [self.rules[rule] for rule, dot in sorted(items) if dot == len(self.rules[rule][1])]
        self.reductions.append([(head, len(body)) for head, body in done if head])
        moves: dict[str, set] = {}
        for rule, dot in sorted(items):
            body = self.rules[rule][1]
            if dot < len(body):
                moves.setdefault(body[dot], set()).add((rule, dot + 1))
        for symbol, after in moves.items():
            self.goto[number, symbol] = self._state(frozenset(after))
        return number


@dataclass(frozen=True, eq=False)
class Node:
    """A state on top of the stack below it; equal stacks are the same node."""

    number: int
    state: int
    below: Node | None = field(repr=False)


#: Stacks with their cost beyond the least one and the rank of their audit.
Tops = tuple[tuple[Node, int, int], ...]


@dataclass(frozen=True)
class Step:
    """What a row does to a set of stacks: the new set, what its least cost adds, and for
    each new stack the one it came from, the inserts before the row, and the row's edit."""

    after: int
    added: int
    back: tuple[tuple[int, int, str], ...]


class Parser:
    """Repairs by one grammar; ``symbols`` are those that may be inserted or rerolled to."""

    def __init__(self, rules: list[Rule], symbols: Iterable[str], costs: Costs = Costs()) -> None:
        self.automaton, self.symbols, self.costs = Automaton(rules), tuple(symbols), costs
        self.nodes: dict[tuple[int, Node | None], Node] = {}
        self.shifts: dict[tuple[Node, str], list[Node]] = {}
        self.sets: list[Tops] = []
        self.number: dict[Tops, int] = {}
        self.steps: dict[tuple[int, Kind], Step] = {}
        self.ends: dict[int, tuple[int, int, int]] = {}
        bottom = self.node(0, None)
        self.start = self._number(tuple((n, 0, 0) for n in self._reduced(bottom)))

    def node(self, state: int, below: Node | None) -> Node:
        key = state, below
        if key not in self.nodes:
            self.nodes[key] = Node(len(self.nodes), state, below)
        return self.nodes[key]

    def _reduced(self, top: Node) -> list[Node]:
        """The stack and all that reductions make of it, those that lead on."""
        found, new = [], [top]
        while new:
            node = new.pop()
            if node in found:
                continue
            found.append(node)
            for head, size in self.automaton.reductions[node.state]:
                below = node
                for _ in range(size):
                    below = below.below
                new.append(self.node(self.automaton.goto[below.state, head], below))
        leads = self.automaton.growing | {self.automaton.accepting}
        return [node for node in found if node.state in leads]

    def shift(self, node: Node, symbol: str) -> list[Node]:
        key = node, symbol
        if key not in self.shifts:
            state = self.automaton.goto.get((node.state, symbol))
            self.shifts[key] = [] if state is None else self._reduced(self.node(state, node))
        return self.shifts[key]

    def _number(self, tops: Tops) -> int:
        if tops not in self.number:
            self.number[tops] = len(self.sets)
            self.sets.append(tops)
        return self.number[tops]

    def _with_inserts(self, tops: Tops) -> dict[Node, tuple[int, int, int, int]]:
        """Stacks after inserts, within the margin: cost, rank, inserts, and the stack each
        came from."""
        most = self.costs.margin + self.costs.delete
        best = {node: (cost, rank, 0, at) for at, (node, cost, rank) in enumerate(tops)}
        new = list(best)
        while new:
            node = new.pop(0)
            cost, rank, inserts, at = best[node]
            longer = cost + self.costs.insert, rank, inserts + 1, at
            if longer[0] > most:
                continue
            for symbol in self.symbols:
                for after in self.shift(node, symbol):
                    if after not in best or longer[:3] < best[after][:3]:
                        best[after] = longer
                        new.append(after)
        return best

    def step(self, number: int, kind: Kind) -> Step:
        found = self.steps.get((number, kind))
        if found is None:
            found = self.steps[number, kind] = self._step(self.sets[number], kind)
        return found

    def _step(self, tops: Tops, kind: Kind) -> Step:
        symbol, extra, lost = kind
        best: dict[Node, tuple[int, int, str, int]] = {}

        def offer(nodes: list[Node], cost: int, rank: int, text: str, at: int) -> None:
            for node in nodes:
                if node not in best or (cost, rank, text) < best[node][:3]:
                    best[node] = cost, rank, text, at

        for node, (cost, rank, inserts, at) in self._with_inserts(tops).items():
            before = INSERT * inserts
            offer([node], cost + self.costs.delete, rank, before + DELETE, at)
            if lost:
                continue
            kept = self.shift(node, symbol)
            offer(kept, cost + extra + self.costs.keep, rank, before + KEEP, at)
            for other in self.symbols:
                rerolled = self.shift(node, other)
                offer(rerolled, cost + extra + self.costs.rerole, rank, before + REROLE, at)
        least = min(cost for cost, *_ in best.values())
        chosen = sorted(
            (n for n, found in best.items() if found[0] - least <= self.costs.margin),
            key=lambda n: n.number,
        )
        order = {text: i for i, text in enumerate(sorted({best[n][1:3] for n in chosen}))}
        after = tuple((n, best[n][0] - least, order[best[n][1:3]]) for n in chosen)
        back = tuple((best[n][3], len(best[n][2]) - 1, best[n][2][-1]) for n in chosen)
        return Step(self._number(after), least, back)

    def end(self, number: int) -> tuple[int, int, int]:
        """What the cheapest end adds, the stack it comes from, and the inserts at the end."""
        if number not in self.ends:
            after = self._with_inserts(self.sets[number])
            done = [found for node, found in after.items() if node.state == self.automaton.accepting]
            cost, _, inserts, at = min(done)
            self.ends[number] = cost, at, inserts
        return self.ends[number]

    def repair(self, kinds: Iterable[Kind]) -> tuple[int, list[str]]:
        """The least cost, and each row's edits: inserts before it and its own. One more
        entry holds the inserts at the end."""
        number, total, steps = self.start, 0, []
        for kind in kinds:
            step = self.step(number, kind)
            steps.append(step)
            number, total = step.after, total + step.added
        cost, at, inserts = self.end(number)
        edits = [INSERT * inserts]
        for step in reversed(steps):
            at, inserts, edit = step.back[at]
            edits.append(INSERT * inserts + edit)
        edits.reverse()
        return total + cost, edits
