"""Min-plus transfer matrices of conversation edits, with audit ropes.

States of the role automaton ``(s?(ua)+)?``: 0 nothing written, 1 after a
system turn, 2 after a user turn, 3 after an assistant turn; 0 and 3 accept.
A matrix maps (state before, state after) to (cost, audit rope) of the cheapest
edits that take a run of rows there, equal costs by ASCII-least audit. Insert
edits stand before a row, never at a run's end, so no audit of a run is a
proper prefix of another and the ASCII order survives concatenation.

A rope is (length, hash, left, right), a leaf (length, hash, text, None): a
product shares its factors' ropes and copies no text.
"""

from __future__ import annotations

#: row classes: role initial s, u, a, other, each whole or truncated, and rows that must go
CLASSES = "sSuUaAoOx"
MUST_GO = "x"
STATES = 4
START, ACCEPT = 0, (0, 3)
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
_PRIME = (1 << 128) - 159
_AFTER = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}

Rope = tuple
Matrix = dict[tuple[int, int], tuple[int, Rope]]


def leaf(text: str) -> Rope:
    return (len(text), int.from_bytes(text.encode(), "big") % _PRIME, text, None)


def joined(x: Rope, y: Rope) -> Rope:
    if not x[0]:
        return y
    if not y[0]:
        return x
    return (x[0] + y[0], (x[1] * pow(256, y[0], _PRIME) + y[1]) % _PRIME, x, y)


def leaves(rope: Rope) -> list[str]:
    out, stack = [], [rope]
    while stack:
        n, _, a, b = stack.pop()
        if b is None:
            out.append(a)
        else:
            stack += (b, a)
    return out


def less(x: Rope, y: Rope) -> bool:
    """ASCII order of the spelled ropes; equal subtrees are skipped by hash."""
    xs, ys = [x], [y]
    while xs and ys:
        a, b = xs.pop(), ys.pop()
        if a[:2] == b[:2]:
            continue
        if a[3] is not None and (b[3] is None or a[0] >= b[0]):
            xs += (a[3], a[2])
            ys.append(b)
        elif b[3] is not None:
            xs.append(a)
            ys += (b[3], b[2])
        else:
            n = min(a[0], b[0])
            if a[2][:n] != b[2][:n]:
                return a[2] < b[2]
            for stack, rest in ((xs, a[2][n:]), (ys, b[2][n:])):
                if rest:
                    stack.append(leaf(rest))
    return bool(ys) and not xs


def better(new: tuple[int, Rope], old: tuple[int, Rope] | None) -> bool:
    return old is None or new[0] < old[0] or (new[0] == old[0] and less(new[1], old[1]))


def _put(m: dict, at, entry) -> None:
    if better(entry, m.get(at)):
        m[at] = entry


def product(m: Matrix, n: Matrix) -> Matrix:
    out: Matrix = {}
    for (i, k), (c1, r1) in m.items():
        for (k2, j), (c2, r2) in n.items():
            if k == k2 and ((i, j) not in out or c1 + c2 <= out[i, j][0]):
                _put(out, (i, j), (c1 + c2, joined(r1, r2)))
    return out


def _inserts() -> Matrix:
    """Fewest inserted rows from state to state."""
    out: Matrix = {(i, i): (0, leaf("")) for i in range(STATES)}
    for i in range(STATES):
        at = i
        for n in range(1, STATES):
            at = next(_AFTER[at, c] for c in "ua" if (at, c) in _AFTER)
            out.setdefault((i, at), (INSERT * n, leaf("I" * n)))
    return out


INSERTS = _inserts()


def class_matrix(row: str) -> Matrix:
    """Matrix of one row of class ``row``."""
    step: Matrix = {(i, i): (DELETE, leaf("D")) for i in range(STATES)}
    if row != MUST_GO:
        more = TRUNCATED if row.isupper() else 0
        for (i, c), j in _AFTER.items():
            if c == row.lower():
                _put(step, (i, j), (KEEP + more, leaf("K")))
            if c != "s":
                _put(step, (i, j), (REROLE + more, leaf("R")))
    return product(INSERTS, step)


def finished(vector: dict[int, tuple[int, Rope]]) -> tuple[int, Rope]:
    """Cheapest end in an accepting state, rows inserted at the end included."""
    best: dict[int, tuple[int, Rope]] = {}
    for k, (c, r) in vector.items():
        for j in ACCEPT:
            if (k, j) in INSERTS:
                _put(best, 0, (c + INSERTS[k, j][0], joined(r, INSERTS[k, j][1])))
    return best[0]


def grammar_matrices(rules: list[str], first: int) -> dict[str, Matrix]:
    """Matrices of all classes and, bottom-up, of every rule: rule ``k`` is the
    character ``first + k`` and stands for two earlier symbols."""
    out = {c: class_matrix(c) for c in CLASSES}
    for k, pair in enumerate(rules):
        out[chr(first + k)] = product(out[pair[0]], out[pair[1]])
    return out
