"""A gated recurrent language model in numpy: its classes, its training step and its scores.

A token is a head word (one of the commonest), a word of a band (the rest of the words held
in memory, by the power of two of their count) or rare (all others, unseen ones among them).
The output is factored by class: the state gives the odds of the classes, some of head words,
one for each band, one for the rare; within a class of head words the state gives the odds of its words,
within a band or the rare a word's share of the counts. So every word has a probability, and
a word costs two small products in place of one over the vocabulary.

Inputs of the gates are a learned row for each head word and for each other class.
"""

from __future__ import annotations

import numpy as np

HIDDEN = 24
#: Head words, and how many of them make a class.
HEAD, CLASS_WORDS = 512, 32
CLASSES = HEAD // CLASS_WORDS
BANDS = 24
RARE = HEAD + BANDS
INPUTS = HEAD + BANDS + 1
#: Count that stands for a place without a word; logits are cut at the most, shares at the least.
NOTHING, MOST_LOGIT, LEAST_SHARE = 1e-20, 60.0, 1e-30
#: Texts read side by side in training, and words that a gradient goes back.
LANES, WINDOW = 128, 16
RATE = 0.08
#: States whose outputs are worked out together when scoring.
OUTPUT_ROWS = 1 << 12

SHAPES = {
    "inputs": (INPUTS, 3 * HIDDEN), "states": (HIDDEN, 3 * HIDDEN), "classes": (HIDDEN + 1, CLASSES + BANDS + 1),
    "words": (CLASSES, HIDDEN + 1, CLASS_WORDS),
}
LENGTHS = {k: int(np.prod(s)) for k, s in SHAPES.items()}


def parts(flat: np.ndarray) -> dict[str, np.ndarray]:
    """Views of the parameters by name; the last row of an output is its offset."""
    out, at = {}, 0
    for name, shape in SHAPES.items():
        out[name] = flat[at : at + LENGTHS[name]].reshape(shape)
        at += LENGTHS[name]
    return out


def initial(head_counts: np.ndarray, class_counts: np.ndarray, seed: int = 12, dtype=np.float32) -> np.ndarray:
    """Parameters under which every state gives the words their shares of the counts.
    head_counts: of HEAD words; class_counts: of all classes."""
    rng = np.random.default_rng(seed)
    flat = np.zeros(sum(LENGTHS.values()), dtype)
    p = parts(flat)
    p["inputs"][:] = rng.normal(0, 0.3, p["inputs"].shape)
    p["states"][:] = rng.normal(0, HIDDEN**-0.5, p["states"].shape)
    there = lambda counts: np.where(counts > 0, counts + 1.0, NOTHING)
    total = there(class_counts)
    total[-1] = class_counts[-1] + 1.0  # the unseen
    p["classes"][-1] = np.log(total) - np.log(total.sum())
    share = there(head_counts).reshape(CLASSES, CLASS_WORDS)
    p["words"][:, -1] = np.log(share / share.sum(axis=1, keepdims=True))
    return flat


def class_of(ids: np.ndarray) -> np.ndarray:
    """Class of an input: HEAD words by CLASS_WORDS, then each band, then the rare."""
    return np.where(ids < HEAD, ids // CLASS_WORDS, ids - HEAD + CLASSES)


def gate_weights(p: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(inputs, states) by gate, as (3, rows, HIDDEN): keep, reset, new. The first two come with
    the sign changed and the last doubled, as a gate is 1 / (1 + exp(-x)) and a new state
    1 - 2 / (1 + exp(2x))."""
    out = []
    for name in ("inputs", "states"):
        by_gate = np.ascontiguousarray(p[name].reshape(-1, 3, HIDDEN).transpose(1, 0, 2))
        by_gate *= np.array([-1, -1, 2], by_gate.dtype)[:, None, None]
        out.append(by_gate)
    return out[0], out[1]


def advance(given: np.ndarray, weights: np.ndarray, h: np.ndarray, from_state, gates, new, after) -> np.ndarray:
    """The next state, written to `after`. given: the tokens' rows of gate_weights(); the arrays
    between h and `after` take what the gradient needs, of the last part of from_state the double.
    An exponential that overflows gives the right gate, 0, or state, 1: callers mute it."""
    np.matmul(h, weights, out=from_state)
    np.add(given[:2], from_state[:2], out=gates)
    np.exp(gates, out=gates)
    gates += 1
    np.reciprocal(gates, out=gates)
    np.multiply(gates[1], from_state[2], out=new)
    new += given[2]
    np.exp(new, out=new)
    new += 1
    np.divide(-2, new, out=new)
    new += 1
    np.subtract(h, new, out=after)
    after *= gates[0]
    after += new
    return after


def step(p: dict[str, np.ndarray], ids: np.ndarray, h: np.ndarray):
    """(next state, (keep, reset, bare, new)) after the tokens `ids`."""
    inputs, weights = gate_weights(p)
    from_state, gates = (np.empty((k, *h.shape), h.dtype) for k in (3, 2))
    new = np.empty_like(h)
    with np.errstate(over="ignore"):
        after = advance(inputs[:, ids], weights, h, from_state, gates, new, np.empty_like(h))
    return after, (gates[0], gates[1], from_state[2] / 2, new)


def odds_of(logits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(exponentials, their sums by row)."""
    odds = np.minimum(logits, MOST_LOGIT, out=logits)
    np.exp(odds, out=odds)
    return odds, odds @ np.ones(odds.shape[1], odds.dtype)


def log_shares(states: np.ndarray, ids: np.ndarray, p: dict[str, np.ndarray], learn: bool = False):
    """Natural log of each token's probability, for bands and the rare that of the class alone;
    with `learn` also the gradients of minus their sum by output and by state."""
    kind = class_of(ids)
    # With a column of ones the offsets, the last rows of the outputs, are weights like others.
    given = np.empty((len(ids), HIDDEN + 1), states.dtype)
    given[:, :-1], given[:, -1] = states, 1
    odds, total = odds_of(given @ p["classes"])
    own = np.arange(len(ids)) * odds.shape[1] + kind  # of each row, in the flat array
    logs = np.log(odds.ravel()[own] / total + LEAST_SHARE)
    grads = {}
    if learn:
        odds *= np.reciprocal(total)[:, None]
        odds.ravel()[own] -= 1
        grads["classes"] = given.T @ odds
        grads["words"] = np.zeros_like(p["words"])
    # Head words in the order of their classes.
    order = np.argsort(kind.astype(np.uint8), kind="stable")  # narrow numbers are sorted by radix
    ends = np.searchsorted(kind[order], np.arange(CLASSES + 1)).tolist()
    order = order[: ends[-1]]
    head = np.take(given, order, axis=0)
    own = np.arange(len(order)) * CLASS_WORDS + np.take(ids, order) % CLASS_WORDS
    shares, back_head = np.empty((len(order), CLASS_WORDS), states.dtype), np.empty((len(order), HIDDEN), states.dtype)
    spans = [(k, slice(ends[k], ends[k + 1])) for k in range(CLASSES) if ends[k] < ends[k + 1]]
    for k, span in spans:
        np.matmul(head[span], p["words"][k], out=shares[span])
    shares, total = odds_of(shares)
    logs[order] += np.log(shares.ravel()[own] / total + LEAST_SHARE)
    if not learn:
        return logs
    shares *= np.reciprocal(total)[:, None]
    shares.ravel()[own] -= 1
    for k, span in spans:
        np.matmul(head[span].T, shares[span], out=grads["words"][k])
        np.matmul(shares[span], p["words"][k, :-1].T, out=back_head[span])
    back = odds @ p["classes"][:-1].T
    back[order] += back_head
    return logs, grads, back


@np.errstate(over="ignore")
def window_gradient(p: dict[str, np.ndarray], ids: np.ndarray, alive: np.ndarray, h: np.ndarray):
    """(minus the log-likelihood, gradients by name, state behind) of a window of tokens
    (steps x lanes); alive is 0 where a text ends, behind which the state begins anew."""
    steps, lanes = ids.shape
    inputs, weights = gate_weights(p)
    given = np.take(inputs, ids, axis=1, mode="clip")
    states, new = np.empty((2, steps, lanes, HIDDEN), h.dtype)
    from_state, gates = (np.empty((k, steps, lanes, HIDDEN), h.dtype) for k in (3, 2))
    whole, alive = alive.all(axis=1), alive[:, :, None]
    states[0] = h
    for t in range(steps):
        after = states[t + 1] if t + 1 < steps else np.empty_like(h)
        h = advance(given[:, t], weights, states[t], from_state[:, t], gates[:, t], new[t], after)
        if not whole[t]:
            h *= alive[t]
    flat = states.reshape(-1, HIDDEN)
    logs, grads, from_output = log_shares(flat, ids.ravel(), p, learn=True)
    from_output = from_output.reshape(steps, lanes, HIDDEN)
    # How far the gradient of a new state reaches its parts, for all steps at once.
    keep, reset = gates
    less = 1 - keep
    by_new = np.multiply(new, new)
    np.subtract(1, by_new, out=by_new)
    by_new *= less
    by_gate = np.empty_like(from_state)
    np.subtract(states, new, out=by_gate[0])
    by_gate[0] *= keep
    by_gate[0] *= less
    np.multiply(by_new, reset, out=by_gate[2])
    np.subtract(1, reset, out=less)
    np.multiply(by_gate[2], from_state[2], out=by_gate[1])
    less *= 0.5
    by_gate[1] *= less
    to_states, to_after = np.empty((steps, lanes, 3 * HIDDEN), h.dtype), np.empty_like(new)
    back = np.ascontiguousarray(p["states"].T)
    to_after[-1], moved = 0, np.empty((lanes, HIDDEN), h.dtype)
    for t in reversed(range(steps)):
        np.multiply(to_after[t], by_gate[:, t], out=to_states[t].reshape(lanes, 3, HIDDEN).transpose(1, 0, 2))
        if t:
            dh = np.multiply(to_after[t], keep[t], out=to_after[t - 1])
            dh += np.matmul(to_states[t], back, out=moved)
            dh += from_output[t]
            if not whole[t - 1]:
                dh *= alive[t - 1]
    grads["states"] = flat.T @ to_states.reshape(-1, 3 * HIDDEN)
    # The inputs reach the gates as the states do, and the new state bare.
    np.multiply(to_after, by_new, out=to_states[:, :, 2 * HIDDEN :])
    names = ids.ravel().astype(np.uint16)
    order = np.argsort(names, kind="stable")
    names = names[order]
    first = np.flatnonzero(np.r_[True, names[1:] != names[:-1]])
    grads["inputs"] = np.zeros_like(p["inputs"])
    grads["inputs"][names[first]] = np.add.reduceat(np.take(to_states.reshape(-1, 3 * HIDDEN), order, axis=0), first, axis=0)
    return -float(logs.sum()), grads, h


class Learner:
    """Truncated backpropagation with steps that shrink by each parameter's own gradients."""

    def __init__(self, flat: np.ndarray):
        self.flat, self.tokens = flat.copy(), 0
        self.p, self.seen = parts(self.flat), np.full_like(self.flat, 1e-6)
        self.gradient = np.zeros_like(self.flat)
        self.g = parts(self.gradient)

    def read(self, ids: np.ndarray, end: int) -> None:
        """Learn from texts in a row, each closed by the token `end`. They are read in LANES
        parts side by side; the state is carried from window to window of a part."""
        lanes = max(1, min(LANES, len(ids) // WINDOW))
        steps = -(-len(ids) // lanes)
        padded = np.full(steps * lanes, end, ids.dtype)
        padded[: len(ids)] = ids
        dealt = np.ascontiguousarray(padded.reshape(lanes, steps).T)
        alive = (dealt != end).astype(self.flat.dtype)
        h = np.zeros((lanes, HIDDEN), self.flat.dtype)
        for t in range(0, steps, WINDOW):
            _, grads, h = window_gradient(self.p, dealt[t : t + WINDOW], alive[t : t + WINDOW], h)
            for name, value in grads.items():
                self.g[name][:] = value
            self.gradient /= dealt[t : t + WINDOW].size
            change = self.gradient * self.gradient
            self.seen += change
            np.sqrt(self.seen, out=change)
            np.divide(self.gradient, change, out=change)
            change *= RATE
            self.flat -= change
        self.tokens += len(ids)


@np.errstate(over="ignore")
def text_logs(flat: np.ndarray, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Natural log of the probability of each text (of its classes, for bands and the rare):
    ids of all texts in a row, of these lengths, each one or more. All texts are read side by
    side from their first token to their last, the state carried all the way."""
    p = parts(flat)
    order = np.argsort(-lengths, kind="stable")
    rank = np.empty(len(lengths), np.int64)
    rank[order] = np.arange(len(lengths))
    begins = np.cumsum(lengths) - lengths
    place = np.arange(len(ids)) - np.repeat(begins, lengths)
    active = len(lengths) - np.searchsorted(np.sort(lengths), np.arange(lengths.max(initial=0)), "right")
    offsets = np.concatenate([[0], np.cumsum(active)])
    packed, owner = np.empty_like(ids), np.empty(len(ids), np.int64)
    texts = np.repeat(np.arange(len(lengths)), lengths)
    at = offsets[place] + rank[texts]
    packed[at], owner[at] = ids, texts
    inputs, weights = gate_weights(p)
    many = len(lengths)
    h, sums = np.zeros((many, HIDDEN), flat.dtype), np.zeros(many)
    from_state, gates = (np.empty((k, many, HIDDEN), flat.dtype) for k in (3, 2))
    new, active, first = np.empty_like(h), np.append(active, 0), 0
    while first + 1 < len(active):
        # Steps of OUTPUT_ROWS tokens or a little more.
        last = min(int(np.searchsorted(offsets, offsets[first] + OUTPUT_ROWS)), len(active) - 1)
        span = slice(offsets[first], offsets[last])
        given = np.take(inputs, packed[span], axis=1, mode="clip")
        states = np.empty(given.shape[1:], flat.dtype)
        states[: active[first]] = h
        for t in range(first, last):
            at, n = offsets[t] - span.start, active[t + 1]  # texts that end are not carried on
            behind = states[at + active[t] :][:n] if t + 1 < last else np.empty((n, HIDDEN), flat.dtype)
            h = advance(given[:, at : at + n], weights, states[at : at + n], from_state[:, :n], gates[:, :n], new[:n], behind)
        logs = log_shares(states, packed[span], p)
        sums += np.bincount(owner[span], weights=logs, minlength=many)
        first = last
    return sums
