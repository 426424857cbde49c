"""Min-plus transfer matrices over a Re-Pair grammar of row codes.

A row of a conversation is one of 16 codes: the role's initial (system, user, assistant, other) and its fault (none, blank,
duplicate, truncated). A matrix holds, for every state before and after a stretch of rows, the cost of the cheapest edits
and the rank of their audit among those that start in the same state. Audits of one stretch that start in one state are
never prefixes of each other (each has one K, R or D per row, the last at its end), and equal ones end in equal states; so
ranks decide ties of joined stretches without a look at the letters. The audit itself is a rope: of each pair of states, a
rule stores only the state between its two halves, and letters are read off at the end.
"""

from __future__ import annotations

import numpy as np

ROLES, OTHER_ROLE = "sua", 3
FINE, BLANK, DUPLICATE, TRUNCATED = 0, 1, 2, 3
CODES = 16
#: States: nothing yet, after the system row, after a user row, after an assistant row. A repaired conversation ends in ENDS.
START, SYSTEM, USER, ASSISTANT = 0, 1, 2, 3
STATES, ENDS = 4, (START, ASSISTANT)
RETURNS, DELETES, INSERTS, LEAVES_TRUNCATED = 1, 2, 5, 5  # fixed costs: reroling, deleting, inserting, keeping a truncated row
INFINITE = 1 << 60


def follows(state: int, role: int) -> int | None:
    """State after a row with this role's initial, or None where it may not stand."""
    if role == 0:
        return SYSTEM if state == START else None
    if role == 1:
        return None if state == USER else USER
    return ASSISTANT if role == 2 and state == USER else None


def expected(state: int) -> int:
    """The role, 1 or 2, that a reroled or inserted row has in this state."""
    return 2 if state == USER else 1


def _row_paths(code: int, state: int) -> dict[int, tuple[int, str]]:
    """Cheapest (cost, audit) to each state over one row, with any inserts before it."""
    role, fault = divmod(code, 4)
    left = LEAVES_TRUNCATED if fault == TRUNCATED else 0
    found: dict[int, tuple[int, str]] = {}
    for inserts in range(STATES):
        cost, audit = INSERTS * inserts, "I" * inserts
        options = [(state, cost + DELETES, audit + "D")]
        if fault in (FINE, TRUNCATED):
            options.append((follows(state, expected(state)), cost + left + RETURNS, audit + "R"))
            if follows(state, role) is not None:
                options.append((follows(state, role), cost + left, audit + "K"))
        for to, c, a in options:
            found[to] = min(found.get(to, (INFINITE, "~")), (c, a))
        state = follows(state, expected(state))
    return found


def _terminals() -> tuple[np.ndarray, np.ndarray, list]:
    cost = np.full((CODES, STATES, STATES), INFINITE, np.int64)
    rank = np.zeros((CODES, STATES, STATES), np.int64)
    audits = []
    for code in range(CODES):
        audits.append([_row_paths(code, i) for i in range(STATES)])
        for i, paths in enumerate(audits[-1]):
            order = sorted(range(STATES), key=lambda j: (j not in paths, paths.get(j, (0, ""))[1]))
            for place, j in enumerate(order):
                rank[code, i, j] = place
                cost[code, i, j] = paths.get(j, (INFINITE,))[0]
    return cost, rank, audits


def compose(cost_a: np.ndarray, rank_a: np.ndarray, cost_b: np.ndarray, rank_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Min-plus product of many pairs of matrices at once: costs, ranks and the states between."""
    through = cost_a[:, :, :, None] + cost_b[:, None, :, :]
    cost = np.minimum(through.min(2), INFINITE)
    among = np.where(through == through.min(2, keepdims=True), rank_a[:, :, :, None], STATES)
    middle = among.argmin(2)
    row, i, j = np.ogrid[: len(cost), :STATES, :STATES]
    key = rank_a[row, i, middle] * STATES + rank_b[row, middle, j] + np.where(cost >= INFINITE, STATES * STATES, 0)
    return cost, key.argsort(2, kind="stable").argsort(2, kind="stable"), middle


class Grammar:
    """Rules in rounds: a round replaces pairs of symbols of the rounds before by new symbols."""

    def __init__(self) -> None:
        self.cost, self.rank, self.audits = _terminals()
        self.middle = np.zeros((CODES, STATES, STATES), np.int64)
        self.left, self.right = np.zeros(CODES, np.int64), np.zeros(CODES, np.int64)
        self.rounds: list[tuple[np.ndarray, np.ndarray]] = []

    def __len__(self) -> int:
        return len(self.left)

    def add(self, pairs: list[tuple[int, int]]) -> None:
        """One round; every rule's matrix is made from those of its two symbols."""
        left, right = (np.array(x, np.int64) for x in zip(*pairs))
        keys, names = (left << 32) | right, len(self) + np.arange(len(left))
        order = np.argsort(keys)
        self.rounds.append((keys[order], names[order]))
        cost, rank, middle = compose(self.cost[left], self.rank[left], self.cost[right], self.rank[right])
        for name, more in (("cost", cost), ("rank", rank), ("middle", middle), ("left", left), ("right", right)):
            setattr(self, name, np.concatenate([getattr(self, name), more]))

    def compress(self, flat: np.ndarray, offsets: np.ndarray, first_round: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Replace pairs, from the left, in sequences that lie one after the other, round by round."""
        for keys, names in self.rounds[first_round:]:
            if len(flat) < 2:
                break
            pairs = (flat[:-1] << 32) | flat[1:]
            at = np.minimum(np.searchsorted(keys, pairs), len(keys) - 1)
            hit = keys[at] == pairs
            inner = offsets[1:-1]
            hit[inner[(inner > 0) & (inner < len(flat))] - 1] = False
            # Of pairs that overlap, every second one counts, from the left.
            begin = hit.copy()
            begin[1:] &= ~hit[:-1]
            start = np.maximum.accumulate(np.where(begin, np.arange(len(hit)), 0))
            hit &= (np.arange(len(hit)) - start) % 2 == 0
            taken = np.flatnonzero(hit)
            flat = flat.copy()
            flat[taken] = names[at[taken]]
            kept = np.ones(len(flat), bool)
            kept[taken + 1] = False
            offsets = np.concatenate([[0], np.cumsum(kept)])[offsets]
            flat = flat[kept]
        return flat, offsets

    def letters(self, symbol: int, i: int, j: int) -> str:
        """The audit of a symbol between two states."""
        out, stack = [], [(symbol, i, j)]
        while stack:
            s, a, b = stack.pop()
            if s < CODES:
                out.append(self.audits[s][a][b][1])
            else:
                m = int(self.middle[s, a, b])
                stack.append((int(self.right[s]), m, b))
                stack.append((int(self.left[s]), a, m))
        return "".join(out)


class Evaluated:
    """Matrices of whole sequences and the way back to their audits."""

    def __init__(self, grammar: Grammar, flat: np.ndarray, offsets: np.ndarray):
        self.grammar = grammar
        self.flat, self.offsets = grammar.compress(flat, offsets)
        lengths = np.diff(self.offsets)
        n = len(lengths)
        self.cost = np.full((n, STATES, STATES), INFINITE, np.int64)
        self.cost[:, range(STATES), range(STATES)] = 0  # an empty sequence changes nothing
        self.rank = np.zeros((n, STATES, STATES), np.int64)
        self._steps: list[tuple[np.ndarray, np.ndarray]] = []
        order = np.argsort(-lengths, kind="stable")
        lengths = lengths[order]
        for t in range(int(lengths[0]) if n else 0):
            rows = order[: int(np.searchsorted(-lengths, -t, side="left"))]
            symbol = self.flat[self.offsets[rows] + t]
            if t == 0:
                self.cost[rows], self.rank[rows] = grammar.cost[symbol], grammar.rank[symbol]
                continue
            cost, rank, middle = compose(self.cost[rows], self.rank[rows], grammar.cost[symbol], grammar.rank[symbol])
            self.cost[rows], self.rank[rows] = cost, rank
            place = np.full(n, -1, np.int64)
            place[rows] = np.arange(len(rows))
            self._steps.append((place if len(rows) < n else np.arange(n), middle.astype(np.int8)))

    def letters(self, row: int, i: int, j: int) -> str:
        symbols = self.flat[self.offsets[row] : self.offsets[row + 1]].tolist()
        states = [j]
        for t in range(len(symbols) - 1, 0, -1):
            place, middle = self._steps[t - 1]
            states.append(int(middle[place[row], i, states[-1]]))
        states.append(i)
        states.reverse()
        return "".join(self.grammar.letters(s, a, b) for s, a, b in zip(symbols, states[:-1], states[1:]))


def ending(cost: np.ndarray, rank: np.ndarray) -> tuple[int, int, int]:
    """(total cost, last state, inserts behind the last row) of the cheapest whole repair, by its costs and ranks from START."""
    best = None
    for j in range(STATES):
        if cost[j] >= INFINITE:
            continue
        inserts, state = 0, j
        while state not in ENDS:
            state, inserts = follows(state, expected(state)), inserts + 1
        option = (int(cost[j]) + INSERTS * inserts, int(rank[j]), j, inserts)
        best = option if best is None else min(best, option)
    return best[0], best[2], best[3]
