"""Rule regexes as one minimal deterministic automaton over bytes.

Regexes become one nondeterministic automaton, subset construction makes it
deterministic, partition refinement makes it minimal, and a transition array over
byte classes runs it. A searching automaton may begin a match at any byte; a placed one
reads on from one byte, or back from it.
"""

from __future__ import annotations

from re import IGNORECASE
from re import _parser as parser  # the standard library's own reading of a regex

import numpy as np

# texts are cut into lanes of this many bytes, which one numpy step advances together
LANE = 2048

# byte put between texts; no rule may match it, so it returns the automaton to its start
BREAK = 0


class _Nfa:
    """States with byte-set edges and empty edges; built from parsed regexes."""

    def __init__(self):
        self.empty: list[list[int]] = []
        self.edges: list[list[tuple[frozenset, int]]] = []

    def state(self) -> int:
        self.empty.append([])
        self.edges.append([])
        return len(self.empty) - 1

    def add(self, parsed, start: int, flags: int) -> int:
        """The state after ``parsed``, entered at ``start``."""
        for op, value in parsed:
            start = self._one(str(op), value, start, flags)
        return start

    def _one(self, op: str, value, start: int, flags: int) -> int:
        if op == "SUBPATTERN":
            _, more, less, inner = value
            return self.add(inner, start, (flags | more) & ~less)
        if op == "BRANCH":
            end = self.state()
            for branch in value[1]:
                first = self.state()
                self.empty[start].append(first)
                self.empty[self.add(branch, first, flags)].append(end)
            return end
        if op == "MAX_REPEAT":
            low, high, inner = value
            for _ in range(low):
                start = self.add(inner, start, flags)
            if high is parser.MAXREPEAT:
                loop = self.state()
                self.empty[start].append(loop)
                self.empty[self.add(inner, loop, flags)].append(loop)
                end = self.state()
                self.empty[loop].append(end)
                return end
            end = self.state()
            for _ in range(high - low):
                self.empty[start].append(end)
                start = self.add(inner, start, flags)
            self.empty[start].append(end)
            return end
        end = self.state()
        self.edges[start].append((_bytes(op, value, flags), end))
        return end

    def turned(self) -> _Nfa:
        """The same states, every edge the other way round."""
        other = _Nfa()
        for _ in self.edges:
            other.state()
        for state, targets in enumerate(self.empty):
            for to in targets:
                other.empty[to].append(state)
        for state, edges in enumerate(self.edges):
            for found, to in edges:
                other.edges[to].append((found, state))
        return other


def _bytes(op: str, value, flags: int) -> frozenset:
    if op == "LITERAL":
        found = {value}
    elif op == "NOT_LITERAL":
        found = set(range(256)) - {value}
    elif op == "IN":
        found, negated = set(), False
        for kind, item in value:
            if str(kind) == "NEGATE":
                negated = True
            elif str(kind) == "LITERAL":
                found.add(item)
            elif str(kind) == "RANGE":
                found.update(range(item[0], item[1] + 1))
            else:
                raise ValueError(f"not supported in a rule: {kind}")
        if negated:
            found = set(range(256)) - found
    else:
        raise ValueError(f"not supported in a rule: {op}")
    if flags & IGNORECASE:
        for byte in list(found):
            letter = chr(byte)
            if "a" <= letter <= "z" or "A" <= letter <= "Z":
                found.add(ord(letter.swapcase()))
    if any(byte > 255 for byte in found):
        raise ValueError("rules are over bytes")
    return frozenset(found - {BREAK})


class Automaton:
    """``table[state * classes + class]`` is the next state times ``classes``.

    ``accepts[state]`` has a bit for every rule that has a match ending there.
    """

    def __init__(self, rules: list[str], searching: bool = True, backward: bool = False):
        nfa = _Nfa()
        root = nfa.state()
        finals: dict[int, int] = {}
        for k, rule in enumerate(rules):
            first = nfa.state()
            nfa.empty[root].append(first)
            finals[nfa.add(parser.parse(rule), first, 0)] = 1 << k
        if backward:
            if len(rules) > 1:
                raise ValueError("one rule is read backward at a time")
            nfa, root, finals = nfa.turned(), next(iter(finals)), {root: 1}
        # bytes that no edge tells apart are one class
        sets = sorted({s for edges in nfa.edges for s, _ in edges}, key=sorted)
        signature = np.array([[b in s for s in sets] for b in range(256)], dtype=bool)
        _, example, classes = np.unique(signature, axis=0, return_index=True, return_inverse=True)
        self.classes = classes.reshape(-1).astype(np.uint8)
        self.width = len(example)
        self.table, self.accepts = _minimal(*_subsets(nfa, root, finals, [int(e) for e in example], searching))
        # the searching automaton forgets everything at a byte that no rule uses
        self.start = 0

    @property
    def states(self) -> int:
        return len(self.accepts)

    def walk(self, data: bytes, at: int, stop: int) -> tuple[int, int]:
        """Where the longest match from ``at`` towards ``stop`` ends, and its rules; (-1, 0) without one.

        For a placed automaton. A stop before ``at`` reads backward, the byte before ``at`` first; the end is then
        the first byte of the match.
        """
        steps, accepts, classes = self._steps()
        state, found, step = 0, (-1, 0), 1 if stop >= at else -1
        while at != stop:
            state = steps[state][classes[data[at if step > 0 else at - 1]]]
            if state < 0:
                break
            at += step
            if accepts[state]:
                found = (at, accepts[state])
        return found

    def _steps(self) -> tuple[list[list[int]], list[int], bytes]:
        """The arrays as lists, which single steps read faster; the state from which no match comes is -1."""
        if not hasattr(self, "_lists"):
            rows = self.table.reshape(-1, self.width) // self.width
            dead = (self.accepts == 0) & (rows == np.arange(len(rows))[:, None]).all(axis=1)
            rows = np.where(dead[rows], -1, rows)
            self._lists = (rows.tolist(), self.accepts.tolist(), self.classes.tobytes())
        return self._lists

    def events(self, texts: list[bytes]) -> list[tuple[int, int, int]]:
        """(text, end, rules) wherever a match of some rule ends; end is exclusive, in bytes.

        One pass: all lanes step together from the start state. A lane's true
        entry state is the last state of the lane before; from it the lane's
        first bytes are run again until both runs agree, which is a few bytes as a rule.
        """
        data = bytes([BREAK]).join(texts) + bytes([BREAK])
        length = len(data)
        lanes = -(-length // LANE)
        flat = np.full(lanes * LANE, self.classes[BREAK], dtype=np.uint8)
        flat[:length] = self.classes[np.frombuffer(data, dtype=np.uint8)]
        columns = np.ascontiguousarray(flat.reshape(lanes, LANE).T)
        table, width = self.table, self.width
        hit_at = np.repeat(self.accepts > 0, width)
        state = np.zeros(lanes, dtype=np.int32)
        ends, marks = [], []
        for step in range(LANE):
            state = table[state + columns[step]]
            hit = hit_at[state]
            if hit.any():
                lane = np.flatnonzero(hit)
                ends.append(lane * LANE + step)
                marks.append(self.accepts[state[lane] // width])
        at = np.concatenate(ends) if ends else np.zeros(0, dtype=np.int64)
        mask = np.concatenate(marks) if marks else np.zeros(0, dtype=np.int64)
        at, mask = self._entered(flat, state, at, mask, lanes)
        offset = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
        owner = np.searchsorted(offset, at, side="right") - 1
        order = np.argsort(at, kind="stable")
        return [(int(owner[k]), int(at[k] - offset[owner[k]] + 1), int(mask[k])) for k in order]

    def _entered(self, flat, last, at, mask, lanes):
        """Run again the beginnings of lanes that are entered in another state than the start."""
        table = self.table
        entry, again_at, again_mask, redone = int(last[0]), [], [], []
        for lane in range(1, lanes):
            true, guess, base = entry, 0, lane * LANE
            step = 0
            while true != guess and step < LANE:
                symbol = int(flat[base + step])
                true, guess = int(table[true + symbol]), int(table[guess + symbol])
                found = int(self.accepts[true // self.width])
                if found:
                    again_at.append(base + step)
                    again_mask.append(found)
                step += 1
            if step:
                redone.append((base, base + step))
            entry = true if step == LANE else int(last[lane])
        if redone:
            starts = np.array([a for a, _ in redone])
            stops = np.array([b for _, b in redone])
            slot = np.searchsorted(starts, at, side="right") - 1
            inside = (slot >= 0) & (at < stops[np.maximum(slot, 0)])
            at = np.concatenate((at[~inside], np.array(again_at, dtype=np.int64)))
            mask = np.concatenate((mask[~inside], np.array(again_mask, dtype=np.int64)))
        return at, mask


def _closure(nfa: _Nfa, states) -> frozenset:
    seen, todo = set(states), list(states)
    while todo:
        for nxt in nfa.empty[todo.pop()]:
            if nxt not in seen:
                seen.add(nxt)
                todo.append(nxt)
    return frozenset(seen)


def _subsets(nfa: _Nfa, root: int, finals: dict[int, int], example: list[int], searching: bool):
    """Subset construction; a searching automaton has the root's closure in every set."""
    begin = _closure(nfa, [root])
    always = begin if searching else frozenset()
    index, order, rows = {begin: 0}, [begin], []
    step: dict[tuple[int, int], frozenset] = {}

    def targets(state: int, byte: int) -> frozenset:
        key = (state, byte)
        if key not in step:
            step[key] = _closure(nfa, [to for s, to in nfa.edges[state] if byte in s])
        return step[key]

    for current in order:  # grows while it is read
        live = [s for s in current if nfa.edges[s]]
        row = []
        for byte in example:
            nxt = always.union(*(targets(s, byte) for s in live))
            if nxt not in index:
                index[nxt] = len(order)
                order.append(nxt)
            row.append(index[nxt])
        rows.append(row)
    accepts = np.array([sum(finals.get(s, 0) for s in states) for states in order], dtype=np.int64)
    return np.array(rows, dtype=np.int32), accepts


def _minimal(rows: np.ndarray, accepts: np.ndarray):
    """Partition refinement until no block is split; the start keeps number 0."""
    _, block = np.unique(accepts, return_inverse=True)
    block = block.reshape(-1)
    count = 0
    while count != block.max() + 1:
        count = block.max() + 1
        _, block = np.unique(np.column_stack((block, block[rows])), axis=0, return_inverse=True)
        block = block.reshape(-1)
    _, first = np.unique(block, return_index=True)
    order = np.argsort(first)  # blocks in the order in which their states were found
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    kept = first[order]
    width = rows.shape[1]
    table = (rank[block[rows[kept]]] * width).astype(np.int32).reshape(-1)
    return table, accepts[kept]
