"""Deterministic transducers over long sequences, in parallel lanes.

A sequence is cut into lanes. All lanes run in step from the root state, and what each position
sees is recorded. Lanes that follow another are then run from the state that the lane
before ends in, until they see what is recorded: from there on, both runs are one. A lane's
state map is thus known for each state that occurs, and maps compose to the exact result;
as a rule lanes fall in step after a few symbols, so one more short run is enough.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: Symbols that one call should hold: callers pass on the last state to the next call.
SEGMENT = 1 << 20
Step = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def groups(length: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of lanes that hold at most ``SEGMENT`` symbols, or one longer lane."""
    out, a, ends = [], 0, np.append(0, np.cumsum(length))
    while a < len(length):
        b = max(a + 1, int(np.searchsorted(ends, ends[a] + SEGMENT, "right")) - 1)
        out.append((a, b))
        a = b
    return out


def scan(step: Step, root: np.ndarray, init: np.ndarray, begin: np.ndarray, length: np.ndarray, follows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(what is emitted, last state) of each transducer (row) and lane (column).

    ``step(states, places)`` gives the next states and what is emitted. Lanes are in order;
    one that ``follows`` goes on where the one before ends, others begin in ``init``. ``root`` has
    the state of each row that says the least about what came before.
    """
    low = int(begin[0]) if len(begin) else 0
    known = np.where(follows, root[:, None], init)
    order = np.argsort(-length, kind="stable")
    final, total, place = known[:, order], np.zeros(known.shape, np.int64), begin[order]
    record = bool(follows.any())
    if record:
        seen = np.zeros((len(root), int((begin + length).max()) - low), np.int32)
        so_far = np.zeros_like(seen)
    active = np.searchsorted(-length[order], -np.arange(1, int(length.max(initial=0)) + 1), "right")
    for t, k in enumerate(active.tolist()):
        p = place[:k] + t
        final[:, :k], emitted = step(final[:, :k], p)
        total[:, :k] += emitted
        if record:
            seen[:, p - low], so_far[:, p - low] = final[:, :k], total[:, :k]
    back = np.argsort(order)
    final, total = final[:, back], total[:, back]
    if not record:
        return total, final
    alone_final, alone_total = final.copy(), total.copy()
    rounds = 0
    while True:
        want = known.copy()
        after = np.flatnonzero(follows)
        want[:, after] = final[:, after - 1]
        wrong = want != known
        row, lane = np.nonzero(wrong)
        if not len(row):
            return total, final
        if rounds >= 2:  # lanes that don't fall in step go one by one
            first = ~(follows[lane - 1] & wrong[row, lane - 1])
            row, lane = row[first], lane[first]
        rounds += 1
        state, sums = want[row, lane], np.zeros(len(row), np.int64)
        known[row, lane] = state
        alive, t = np.arange(len(row)), 0
        while len(alive):
            p = begin[lane[alive]] + t
            state[alive], emitted = step(state[alive], p)
            sums[alive] += emitted
            same = seen[row[alive], p - low] == state[alive]
            i = alive[same]
            sums[i] += alone_total[row[i], lane[i]] - so_far[row[i], p[same] - low]
            state[i] = alone_final[row[i], lane[i]]
            t += 1
            alive = alive[~same]
            alive = alive[t < length[lane[alive]]]
        final[row, lane], total[row, lane] = state, sums
