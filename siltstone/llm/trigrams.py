"""Boolean trigram queries that every match of a regular expression satisfies."""

from __future__ import annotations

from itertools import product
from re import _constants as c  # the parser's opcodes
from re import _parser

#: Strings of an exact set, and characters of a class, up to which they are enumerated.
MOST_STRINGS, MOST_CHARS = 64, 16

#: A query in conjunctive form: each member is a set of alternatives, each alternative
#: a set of trigrams that occur together. An empty query says nothing.
Query = frozenset


class Node:
    """What is known of the strings a piece of the pattern matches.

    ``exact`` is their full set, if small; otherwise ``prefix`` and ``suffix``
    hold what they may begin and end with, and ``query`` what they must contain.
    """

    def __init__(self, exact=None, prefix=("",), suffix=("",), query=Query()):
        self.exact = frozenset(exact) if exact is not None else None
        self.prefix = frozenset(prefix) if exact is None else self.exact
        self.suffix = frozenset(suffix) if exact is None else self.exact
        self.query = query


def must(strings) -> Query:
    """One of ``strings`` occurs: an alternative for each, or nothing if one is short."""
    if not strings or any(len(s) < 3 for s in strings):
        return Query()
    return Query([frozenset(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings)])


def cut(strings, front: bool) -> frozenset:
    """Ends of strings, shortened until few remain."""
    for n in (8, 4, 2, 1, 0):
        short = {s[:n] if front else s[len(s) - n :] if n else "" for s in strings}
        if len(short) <= MOST_STRINGS:
            return frozenset(short)
    return frozenset([""])


def loose(x: Node) -> Node:
    """Without the exact set, whose trigrams move to the query."""
    if x.exact is None:
        return x
    return Node(None, cut(x.exact, True), cut(x.exact, False), x.query | must(x.exact))


def join(a: Node, b: Node) -> Node:
    if a.exact is not None and b.exact is not None and len(a.exact) * len(b.exact) <= MOST_STRINGS:
        return Node({x + y for x, y in product(a.exact, b.exact)}, query=a.query | b.query)
    la, lb = loose(a), loose(b)
    over = {x[-2:] + y[:2] for x, y in product(la.suffix, lb.prefix)} if len(la.suffix) * len(lb.prefix) <= MOST_STRINGS**2 else {""}
    wide = {x + y for x, y in product(la.suffix, lb.prefix)} if len(la.suffix) * len(lb.prefix) <= MOST_STRINGS else over
    prefix = {x + y for x, y in product(a.exact, lb.prefix)} if a.exact is not None and len(a.exact) * len(lb.prefix) <= MOST_STRINGS else la.prefix
    suffix = {x + y for x, y in product(la.suffix, b.exact)} if b.exact is not None and len(la.suffix) * len(b.exact) <= MOST_STRINGS else lb.suffix
    return Node(None, cut(prefix, True), cut(suffix, False), la.query | lb.query | must(wide))


def either(nodes: list[Node]) -> Node:
    if all(x.exact is not None for x in nodes) and sum(len(x.exact) for x in nodes) <= MOST_STRINGS:
        return Node({s for x in nodes for s in x.exact})
    nodes = [loose(x) for x in nodes]
    query = Query()
    if all(x.query for x in nodes):  # each branch's cheapest requirement, as alternatives
        query = Query([frozenset(alt for x in nodes for alt in min(x.query, key=lambda q: (len(q), -min(map(len, q)))))])
    return Node(None, cut({s for x in nodes for s in x.prefix}, True), cut({s for x in nodes for s in x.suffix}, False), query)


def chars(items, fold: bool) -> Node:
    found: set[str] = set()
    for op, arg in items:
        if op is c.LITERAL:
            found.add(chr(arg))
        elif op is c.RANGE and arg[1] - arg[0] < 128:
            found |= {chr(x) for x in range(arg[0], arg[1] + 1)}
        else:
            return Node()
    found = {lower(x) for x in found} if fold else found
    return Node(found) if len(found) <= MOST_CHARS else Node()


def lower(text: str) -> str:
    """ASCII only, as the index folds bytes."""
    return "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text)


def walk(parsed) -> Node:
    out = Node([""])
    for op, arg in parsed:
        if op is c.LITERAL:
            x = Node([lower(chr(arg))])
        elif op is c.IN:
            x = chars(arg, True)
        elif op is c.SUBPATTERN:
            x = walk(arg[-1])
        elif op is c.BRANCH:
            x = either([walk(p) for p in arg[1]])
        elif op in (c.MAX_REPEAT, c.MIN_REPEAT, c.POSSESSIVE_REPEAT):
            least, most, inner = arg
            x = walk(inner)
            if (least, most) == (0, 1) and x.exact is not None:
                x = Node(x.exact | {""})
            elif least == 0:
                x = Node()
            else:
                once = x
                for _ in range(min(least, 4) - 1):
                    x = join(x, once)
                x = x if least == most and least <= 4 else loose(x)
        elif op in (c.AT, c.ASSERT, c.ASSERT_NOT):
            x = Node([""])
        else:
            x = Node()
        out = join(out, x)
    return out


def query_of(pattern: str) -> list[list[frozenset[str]]]:
    """AND over members of OR over alternatives of trigrams, lower-cased; [] if none is mandatory."""
    found = loose(walk(_parser.parse(pattern))).query
    least = [{a for a in m if not any(b < a for b in m)} for m in found]  # an alternative that asks for more says nothing
    members = [sorted(m, key=sorted) for m in least]
    return sorted(members, key=lambda m: (len(m), [sorted(a) for a in m]))
