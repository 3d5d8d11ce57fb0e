"""Generalised LR parsing of role sequences with weighted edits.

The role grammar says which sequences of role initials are whole conversations:

    S -> (nothing) | P | s P        P -> u a | P u a

Its SLR(1) tables are made from these rules. A parse stack is a chain of interned nodes, so equal
stacks are one node of a graph, and a frontier maps each live stack top to the cheapest way to it: the
smallest (cost, audit), the audit being the initials of the edits so far. The rules recurse to the
left, so there are only a few distinct stacks and a row costs the same wherever it stands.

Keeping only the minimum of equal stack tops is exact. Two edit lists of equal cost over the same rows
that lead to the same stack are never proper beginnings of one another: the longer one would have
more inserts and the same other edits, and would cost more. So what follows cannot turn their order.
"""

from __future__ import annotations

from functools import lru_cache
from typing import NamedTuple

RULES = (("S", ""), ("S", "P"), ("S", "sP"), ("P", "ua"), ("P", "Pua"))
START, END = "S", "$"
KEEP, REROLE, DELETE, INSERT = "KRDI"
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 1, 2, 5, 5
#: Initials that the grammar knows, and those that edits may give.
TOKENS = ("s", "u", "a")
GIVEN = ("u", "a")


class Row(NamedTuple):
    """What the parser needs of a row; `copies` equal rows follow one another."""
    initial: str
    must_go: bool
    truncated: bool
    copies: int = 1


def _closure(items):
    items = set(items)
    todo = list(items)
    while todo:
        rule, dot = todo.pop()
        after = RULES[rule][1][dot:dot + 1]
        for new in [(k, 0) for k, (head, _) in enumerate(RULES) if head == after]:
            if new not in items:
                items.add(new)
                todo.append(new)
    return frozenset(items)


def _follow():
    """Tokens that may come after each head; no rule for P is empty, so firsts are plain."""
    firsts = {"s": {"s"}, "u": {"u"}, "a": {"a"}, "P": {"u"}}
    follow = {"S": {END}, "P": set()}
    for _ in RULES:
        for head, body in RULES:
            for symbol, after in zip(body, [*body[1:], None]):
                if symbol in follow:
                    follow[symbol] |= firsts[after] if after else follow[head]
    return follow


def _tables():
    """moves[state, symbol] = state and reductions[state, token] = rules; state 0 is the start."""
    states = [_closure((k, 0) for k, (head, _) in enumerate(RULES) if head == START)]
    moves, reductions, follow = {}, {}, _follow()
    for state in states:
        at = states.index(state)
        for symbol in sorted({RULES[rule][1][dot] for rule, dot in state if dot < len(RULES[rule][1])}):
            new = _closure((rule, dot + 1) for rule, dot in state if RULES[rule][1][dot:dot + 1] == symbol)
            if new not in states:
                states.append(new)
            moves[at, symbol] = states.index(new)
        for rule, dot in state:
            if dot == len(RULES[rule][1]):
                for token in follow[RULES[rule][0]]:
                    reductions.setdefault((at, token), []).append(rule)
    return moves, reductions


MOVES, REDUCTIONS = _tables()


class Node(NamedTuple):
    """The top of a stack and what lies below it."""
    state: int
    below: Node | None


@lru_cache(maxsize=None)
def node(state: int, below: Node | None = None) -> Node:
    return Node(state, below)


ROOT = node(0)


def _reduced(top: Node, token: str):
    """All stacks that reductions before `token` lead to, the given one included; None is the accepted one."""
    found, todo = [], [top]
    while todo:
        top = todo.pop()
        found.append(top)
        for rule in REDUCTIONS.get((top.state, token), ()) if top else ():
            head, body = RULES[rule]
            base = top
            for _ in body:
                base = base.below
            if head == START:
                found.append(None)
            else:
                todo.append(node(MOVES[base.state, head], base))
    return found


@lru_cache(maxsize=None)
def advance(top: Node, token: str) -> tuple[Node, ...]:
    """The stacks after `token`; none where the grammar doesn't allow it."""
    if token not in TOKENS:
        return ()
    return tuple(node(MOVES[t.state, token], t) for t in _reduced(top, token) if t and (t.state, token) in MOVES)


@lru_cache(maxsize=None)
def accepts(top: Node) -> bool:
    return None in _reduced(top, END)


def _all_tops():
    tops = [ROOT]
    for top in tops:
        tops += [new for token in TOKENS for new in advance(top, token) if new not in tops]
    return tuple(tops)


#: Every stack that can stand between two rows. Blocks name a stack by its place in this list.
TOPS = _all_tops()
PLACE = {top: k for k, top in enumerate(TOPS)}


def offer(frontier: dict, top, way: tuple) -> bool:
    """Keep the cheaper of two ways to one stack; a way starts with its cost and audit."""
    old = frontier.get(top)
    if old is None or way[:2] < old[:2]:
        frontier[top] = way
        return True
    return False


def with_inserts(frontier: dict) -> dict:
    """The frontier with every worthwhile run of inserted rows; ways are (cost, audit, roles)."""
    frontier, todo = dict(frontier), list(frontier)
    while todo:
        top = todo.pop()
        cost, audit, roles = frontier[top]
        for token in GIVEN:
            for new in advance(top, token):
                if offer(frontier, new, (cost + INSERT_COST, audit + INSERT, roles + token)):
                    todo.append(new)
    return frontier


def step(frontier: dict, row: Row) -> dict:
    """The frontier after one row and its copies; copies behind the first are duplicates and go."""
    after: dict = {}
    more = row.copies - 1
    tail = (more * DELETE_COST, DELETE * more, "-" * more)
    extra = TRUNCATED_COST if row.truncated else 0
    for top, (cost, audit, roles) in with_inserts(frontier).items():
        edits = [(top, DELETE_COST, DELETE, "-")]
        if not row.must_go:
            edits += [(new, extra, KEEP, row.initial) for new in advance(top, row.initial)]
            edits += [(new, extra + REROLE_COST, REROLE, token) for token in GIVEN for new in advance(top, token)]
        for new, price, letter, role in edits:
            offer(after, new, (cost + price + tail[0], audit + letter + tail[1], roles + role + tail[2]))
    return after


def best_end(frontier: dict) -> tuple[Node, tuple]:
    """The cheapest accepted stack, inserts at the end included: (its top, its way)."""
    ends = with_inserts(frontier)
    top = min(filter(accepts, ends), key=lambda end: ends[end][:2])
    return top, ends[top]


def parse(rows: list[Row]) -> tuple[int, str, str]:
    """(cost, audit, roles) of the cheapest repair of one whole conversation."""
    frontier = {ROOT: (0, "", "")}
    for row in rows:
        frontier = step(frontier, row)
    return best_end(frontier)[1]
