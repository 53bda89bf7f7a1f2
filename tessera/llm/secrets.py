"""Secret scans with one deterministic automaton for all rules.

Rules are parsed into Thompson automata over bytes; subset construction and
minimisation of their union give a transition array that finds, in one pass over a
text's bytes, each rule's possible ends of matches. Each rule has two small automata of its own besides: a reversed
one, which leads from an end to the leftmost start, and one anchored there for the longest end.
The spans are those of a leftmost search that takes the longest match, for rules of which no match
begins inside an earlier one and ends before that one can.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

from pyspark.sql import DataFrame, functions as F

VALUE = "[A-Za-z0-9+/_.=-]"
KEYWORDS = ["password", "passwd", "secret", "token", "api_?key"]


def either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


#: kind -> (pattern, least characters: of the value for assign, else of the match). Base kinds come first.
#: Only hex carries its least length in the pattern, as its runs are everywhere in prose; a shorter run
#: holds no match, so the spans are the same. Elsewhere counting would multiply the automaton's states.
RULES: dict[str, tuple[str, int]] = {
    "assign": ("(" + "|".join(map(either_case, KEYWORDS)) + ")[\"']?\x20*[:=]\x20*[\"']?" + VALUE + "+", 12),
    "access": ("AKIA[A-Z0-9]+", 18),
    "hex": ("[0-9a-f]{16,}", 16),
    "github": ("gh[pousr]_[A-Za-z0-9]+", 40),
    "jwt": ("eyJ[A-Za-z0-9_-]+[.]eyJ[A-Za-z0-9_-]+[.][A-Za-z0-9_-]+", 40),
    "key": ("-----BEGIN( [A-Z]+)? PRIVATE KEY-----", 0),
    "slack": ("xox[abprs]-[A-Za-z0-9-]+", 15),
}
BASE = ("assign", "access", "hex")


# --- regular expressions to automata -------------------------------------------------


def parse(pattern: str):
    """A tree of ("set", bytes), ("cat", ...), ("alt", ...), ("rep", tree, least, most or None)."""
    data, at = pattern.encode(), 0

    def alt():
        nonlocal at
        parts = [cat()]
        while at < len(data) and data[at] == ord("|"):
            at += 1
            parts.append(cat())
        return parts[0] if len(parts) == 1 else ("alt", *parts)

    def cat():
        parts = []
        while at < len(data) and data[at] not in b"|)":
            parts.append(repeated(atom()))
        return ("cat", *parts)

    def atom():
        nonlocal at
        c = data[at]
        at += 1
        if c == ord("("):
            tree = alt()
            at += 1
            return tree
        if c == ord("["):
            end = data.index(b"]", at)
            inner, at = data[at:end], end + 1
            out, i = set(), 0
            while i < len(inner):
                if i + 2 < len(inner) and inner[i + 1] == ord("-"):
                    out |= set(range(inner[i], inner[i + 2] + 1))
                    i += 3
                else:
                    out.add(inner[i])
                    i += 1
            return ("set", frozenset(out))
        return ("set", frozenset([c]))

    def repeated(tree):
        nonlocal at
        while at < len(data) and data[at] in b"?*+{":
            c = data[at]
            at += 1
            if c == ord("{"):
                end = data.index(b"}", at)
                low, _, high = data[at:end].decode().partition(",")
                most = int(low) if "," not in data[at:end].decode() else int(high) if high else None
                tree, at = ("rep", tree, int(low), most), end + 1
            else:
                tree = ("rep", tree, int(c == ord("+")), 1 if c == ord("?") else None)
        return tree

    return alt()


def flipped(tree):
    """The tree of the reversed language."""
    if tree[0] == "set":
        return tree
    if tree[0] == "rep":
        return ("rep", flipped(tree[1]), *tree[2:])
    parts = [flipped(x) for x in tree[1:]]
    return (tree[0], *(parts[::-1] if tree[0] == "cat" else parts))


class Nfa:
    def __init__(self):
        self.free: list[list[int]] = []
        self.step: list[tuple[frozenset, int] | None] = []

    def state(self) -> int:
        self.free.append([])
        self.step.append(None)
        return len(self.free) - 1

    def add(self, tree, at: int) -> int:
        """Build the tree from state ``at``; its end state."""
        if tree[0] == "set":
            to = self.state()
            if self.step[at] is not None:
                mid = self.state()
                self.free[at].append(mid)
                at = mid
            self.step[at] = (tree[1], to)
            return to
        if tree[0] == "cat":
            for x in tree[1:]:
                at = self.add(x, at)
            return at
        if tree[0] == "alt":
            end = self.state()
            for x in tree[1:]:
                begin = self.state()
                self.free[at].append(begin)
                self.free[self.add(x, begin)].append(end)
            return end
        _, inner, least, most = tree
        for _ in range(least):
            at = self.add(inner, at)
        end = self.state()
        if most is None:
            loop = self.state()
            self.free[at].append(loop)
            self.free[self.add(inner, loop)].append(loop)
            self.free[loop].append(end)
            return end
        self.free[at].append(end)
        for _ in range(most - least):
            at = self.add(inner, at)
            self.free[at].append(end)
        return end


def closure(nfa: Nfa, states) -> frozenset:
    seen, todo = set(states), list(states)
    while todo:
        for x in nfa.free[todo.pop()]:
            if x not in seen:
                seen.add(x)
                todo.append(x)
    return frozenset(seen)


def subsets(nfa: Nfa, start: int, ends: dict[int, int], anywhere: bool):
    """(transitions, rule bits) by subset construction; with ``anywhere`` a match may begin at every byte."""
    first = closure(nfa, [start])
    sets = {x[0] for x in nfa.step if x}
    alike: dict[tuple, list[int]] = {}
    for b in range(256):
        alike.setdefault(tuple(b in x for x in sets), []).append(b)
    ids, todo, table, bits = {first: 0}, [first], [], []
    while todo:
        now = todo.pop(0)
        bits.append(sum({1 << ends[x] for x in now if x in ends}))
        row = [0] * 256
        for group in alike.values():  # bytes that no rule tells apart
            to = {s[1] for x in now if (s := nfa.step[x]) and group[0] in s[0]}
            nxt = closure(nfa, to | ({start} if anywhere else set()))
            if nxt not in ids:
                ids[nxt] = len(ids)
                todo.append(nxt)
            for b in group:
                row[b] = ids[nxt]
        table.append(row)
    return table, bits


def minimised(table: list[list[int]], bits: list[int]):
    """Moore's refinement; the state of the start keeps number 0."""
    block = {b: i for i, b in enumerate(dict.fromkeys(bits))}
    part = [block[b] for b in bits]
    while True:
        keys = [(part[i], *(part[t] for t in row)) for i, row in enumerate(table)]
        names = {k: i for i, k in enumerate(dict.fromkeys(keys))}
        new = [names[k] for k in keys]
        if len(names) == len(set(part)):
            break
        part = new
    some = {p: i for i, p in reversed(list(enumerate(new)))}
    return [[new[t] for t in table[some[p]]] for p in range(len(names))], [bits[some[p]] for p in range(len(names))]


def automaton(trees, anywhere: bool):
    nfa = Nfa()
    start = nfa.state()
    ends = {}
    for k, tree in enumerate(trees):
        begin = nfa.state()
        nfa.free[start].append(begin)
        ends[nfa.add(tree, begin)] = k
    return minimised(*subsets(nfa, start, ends, anywhere))


class Scanner:
    """All rules compiled. ``spans`` gives (kind, start, end) in bytes, leftmost and not overlapping per kind."""

    def __init__(self, rules: dict[str, tuple[str, int]]):
        self.kinds = list(rules)
        trees = [parse(p) for p, _ in rules.values()]
        table, bits = automaton(trees, anywhere=True)
        # states that end a match come last, so that one comparison tells them
        order = sorted(range(len(bits)), key=lambda s: (bits[s] != 0, s))
        rank = {s: i for i, s in enumerate(order)}
        self.start = rank[0]
        self.step = [[rank[t] for t in table[s]] for s in order]
        self.bits = [bits[s] for s in order]
        self.ending = next((i for i, b in enumerate(self.bits) if b), len(self.bits))
        self.forward = [automaton([t], anywhere=False) for t in trees]
        self.backward = [automaton([flipped(t)], anywhere=False) for t in trees]
        lost = lambda a: next((i for i, row in enumerate(a[0]) if not a[1][i] and row == [i] * 256), -1)
        self.dead = [(lost(b), lost(f)) for b, f in zip(self.backward, self.forward)]
        self.least = [n for _, n in rules.values()]
        value = parse(VALUE)[1][1]
        self.value = bytes(b in value for b in range(256))

    def ends(self, data: bytes):
        """The one pass: (end, rule bits) wherever some rule's match may end."""
        state, step, ending = self.start, self.step, self.ending
        out = []
        for at, b in enumerate(data):
            state = step[state][b]
            if state >= ending:
                out.append((at + 1, self.bits[state]))
        return out

    def spans(self, data: bytes) -> list[tuple[int, int, int]]:
        last = [0] * len(self.kinds)
        found = []
        for end, bits in self.ends(data):
            k = 0
            while bits:
                if bits & 1 and end > last[k]:
                    step, accept = self.backward[k]
                    start, state = -1, 0
                    for at in range(end - 1, last[k] - 1, -1):
                        state = step[state][data[at]]
                        if accept[state]:
                            start = at
                        elif state == self.dead[k][0]:
                            break
                    if start >= 0:
                        step, accept = self.forward[k]
                        state, stop = 0, end
                        for at in range(start, len(data)):
                            state = step[state][data[at]]
                            if accept[state]:
                                stop = at + 1
                            elif state == self.dead[k][1]:
                                break
                        last[k] = stop
                        size = self.valued(data, start, stop) if self.kinds[k] == "assign" else stop - start
                        if size >= self.least[k]:
                            found.append((start, k, stop))
                bits >>= 1
                k += 1
        return sorted(found)

    def valued(self, data: bytes, start: int, stop: int) -> int:
        """Characters of the value of an assignment: what follows the separator, its spaces and quote."""
        at = start
        while at < stop and data[at] not in b":=":
            at += 1
        at += 1
        while at < stop and not self.value[data[at]]:
            at += 1
        return stop - at


@lru_cache(maxsize=4)
def scanner(names: tuple[str, ...] = tuple(RULES)) -> Scanner:
    return Scanner({k: RULES[k] for k in names})


def characters(data: bytes, at: list[int]) -> dict[int, int]:
    """Code point offsets of ascending byte offsets."""
    out, chars, last = {}, 0, 0
    for x in at:
        chars += len(data[last:x].decode("utf-8", "replace"))
        last = x
        out[x] = chars
    return out


def scan(docs: DataFrame) -> DataFrame:
    """Spans of secrets in every text, with the input's doc_id: n_assign, n_access, n_hex, base_sha256, spans.

    Spans are kind:start:end in code points, end exclusive, by start and then kind in
    the order of ``RULES``, comma-joined. Null and empty texts have none. Rows are
    independent of each other: repeated rows give equal rows, an empty table an empty
    result; further columns are ignored.
    """
    import pyarrow as pa

    kinds = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string())])

    def rows(batches):
        one = scanner()
        for batch in batches:
            out = []
            for doc_id, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = one.spans(data or b"")
                to = characters(data or b"", sorted({x for s, _, e in found for x in (s, e)}))
                named = [(one.kinds[k], f"{one.kinds[k]}:{to[s]}:{to[e]}") for s, k, e in found]
                base = [x for kind, x in named if kind in BASE]
                count = {b: sum(kind == b for kind, _ in named) for b in BASE}
                out.append({"doc_id": doc_id, **{f"n_{b}": count[b] for b in BASE}, "base_sha256": hashlib.sha256(",".join(base).encode()).hexdigest(), "spans": ",".join(x for _, x in named)})
            yield pa.RecordBatch.from_pylist(out, kinds)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(rows, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def op9_secrets(spark, sf_dir: str) -> DataFrame:
    from .common import documents, spread

    return scan(spread(documents(spark, sf_dir)))
