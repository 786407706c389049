"""Operator 1: token counts by a compiled finite-state tokenizer.

The merges of a BPE vocabulary are compiled, state by state as they are met, into a deterministic transducer
over bytes. A transition carries how many tokens more (or fewer) the text so far has; the sum along a text is
its token count. What a state holds is what the future can depend on: for each place from which a vocabulary
entry may still run on, the last token of the encoding up to that place and how many tokens that encoding has.
Two neighbouring tokens can stand together exactly if the merges of their joined bytes give these two back, so
the encoding of a prefix is the one valid token at its end put after the encoding of what stands before.

A batch is one stream of bytes cut into equal chunks. A chunk's state map is constant after its first
pre-token end, whatever state it is entered with: all chunks run from there in lockstep, each array step moving
every chunk by a byte. A prefix scan over the maps gives each chunk's entry state, and the heads run in a second
lockstep from these. Chunks without any pre-token end hand their whole map on, round by round.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from ._pretokens import PreTokens, vocabulary
from ._spark import map_batches, texts

_UNKNOWN = -1


def byte_names() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    names = {b: chr(b) for b in shown}
    for b in range(256):
        names.setdefault(b, chr(0x100 + len(names) - len(shown)))
    return [names[b] for b in range(256)]


class Transducer:
    """Token-counting transducer of one vocabulary file. Symbols 0..255: bytes inside a pre-token; 256..511: last bytes.

    It is grown lazily and starts anew beyond ``most_states`` states (``most_seen`` remembered pre-tokens), so its
    memory is bounded whatever the texts hold.
    """

    def __init__(self, path: str, most_states: int = 60_000, most_seen: int = 4_000_000):
        _, model, _ = vocabulary(path)
        self.most_states = most_states
        code = {name: b for b, name in enumerate(byte_names())}
        end = model["end_of_word_suffix"] or ""

        def symbols(token: str) -> tuple[int, ...]:
            closed = bool(end) and token.endswith(end) and len(token) > len(end)
            out = [code[c] for c in (token[: -len(end)] if closed else token)]
            return (*out[:-1], out[-1] + 256 * closed)

        self.token = {symbols(t): i for t, i in model["vocab"].items()}
        self.symbols = {i: s for s, i in self.token.items()}
        # The trie of all entries: node << 9 | symbol leads to a node; ``entry`` is the token that ends there.
        self.child: dict[int, int] = {}
        self.entry, self.inner = [-1], [True]
        for symbols_of, i in self.token.items():
            node = 0
            for s in symbols_of:
                self.inner[node] = True
                if (to := self.child.get(node << 9 | s)) is None:
                    to = self.child[node << 9 | s] = len(self.entry)
                    self.entry.append(-1)
                    self.inner.append(False)
                node = to
            self.entry[node] = i
        vocab = model["vocab"]
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for r, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.rank[vocab[a], vocab[b]] = (r, vocab[a + b])
        self.parts = {made: (r, pair) for pair, (r, made) in self.rank.items()}
        self.spines: tuple[dict, dict] = ({}, {})
        self.most_seen, self.seen, self.found = most_seen, np.zeros(1, dtype=np.uint64), np.zeros(1, dtype=np.int32)
        self.fits: dict[int, bool] = {}
        self.reset()

    def reset(self) -> None:
        # A state: for each place from which an entry may still run on, its node, the last token before that place
        # and how many tokens stood there, counted from now.
        self.states: list[tuple] = [((0, -1, 0),)]
        self.ids: dict[tuple, int] = {self.states[0]: 0}
        self.fits.clear()
        self.column = np.full(512, _UNKNOWN, dtype=np.int64)
        self.width, self.used = 64, 0
        self.table = np.full((1024, self.width), _UNKNOWN, dtype=np.int32)

    def encode(self, symbols: tuple[int, ...]) -> list[int]:
        """Merge by rank, the definition of the vocabulary's encoding."""
        out = [self.token[(s,)] for s in symbols]
        while len(out) > 1:
            ranked = [(self.rank[p][0], k) for k, p in enumerate(zip(out, out[1:], strict=False)) if p in self.rank]
            if not ranked:
                break
            _, k = min(ranked)
            out[k : k + 2] = [self.rank[out[k], out[k + 1]][1]]
        return out

    def spine(self, token: int, side: int) -> list[tuple[int, int, float]]:
        """Tokens that stand at one end of ``token`` while it is merged: (token, rank that makes it, rank that takes it up)."""
        if (known := self.spines[side].get(token)) is None:
            known, taken = [], float("inf")
            while token in self.parts:
                made, pair = self.parts[token]
                known.append((token, made, taken))
                token, taken = pair[side], made
            known.append((token, -1, taken))
            self.spines[side][known[0][0]] = known
        return known

    def fit(self, left: int, right: int) -> bool:
        """May ``right`` follow ``left`` in an encoding?

        Not if some merge joins the two sides: its rank must lie after both of its tokens are made and before
        either is taken up within its own side (of equal pairs the left one merges first).
        """
        for x, made_x, taken_x in self.spine(left, 1):
            for y, made_y, taken_y in self.spine(right, 0):
                got = self.rank.get((x, y))
                if got is not None and made_x < got[0] < taken_x and made_y < got[0] <= taken_y:
                    return False
        return True

    def move(self, state: int, symbol: int) -> tuple[int, int]:
        """Next state and how many tokens are added."""
        token, added, open_ends = -1, 0, []
        for node, last, n in self.states[state]:
            to = self.child.get(node << 9 | symbol)
            if to is None:
                continue
            if token < 0 and (entry := self.entry[to]) >= 0:
                if last < 0:
                    ok = True
                elif (ok := self.fits.get(last << 32 | entry)) is None:
                    ok = self.fits[last << 32 | entry] = self.fit(last, entry)
                if ok:
                    token, added = entry, n + 1
            if self.inner[to]:
                open_ends.append((to, last, n))
        if token < 0:
            raise ValueError("no token fits; the vocabulary lacks a byte")
        if symbol >= 256:
            return 0, added
        key = (*((to, last, n - added) for to, last, n in open_ends), (0, token, 0))
        got = self.ids.get(key)
        if got is None:
            got = self.ids[key] = len(self.states)
            self.states.append(key)
        return got, added

    def learn(self, states: np.ndarray, symbols: np.ndarray) -> None:
        """Fill in the transitions that are asked for."""
        for s in np.unique(symbols[self.column[symbols] == _UNKNOWN]):
            self.column[s] = self.used
            self.used += 1
        for state, symbol in {*zip(states.tolist(), symbols.tolist(), strict=True)}:
            to, added = self.move(state, symbol)
            if len(self.states) > len(self.table) or self.used > self.width:
                wide = np.full((max(len(self.table), len(self.states) * 3 // 2), max(self.width, -(-self.used // 64) * 64)), _UNKNOWN, dtype=np.int32)
                wide[: len(self.table), : self.width] = self.table
                self.table, self.width = wide, wide.shape[1]
            self.table[state, self.column[symbol]] = to << 8 | (added + 0x80)

    def run(self, lanes: np.ndarray, entry: np.ndarray, length: np.ndarray, deltas: np.ndarray) -> np.ndarray:
        """Move each lane from its entry state over ``length`` symbols of its row; write the deltas; give the end states.

        lanes, deltas: [steps, lanes]; lanes must be ordered by falling length.
        """
        state = entry.copy()
        active = np.searchsorted(-length, -np.arange(len(lanes)), side="left") if len(lanes) else []
        for k in range(len(lanes)):
            n = active[k]
            if not n:
                break
            here, symbols = state[:n], lanes[k, :n]
            at = self.column[symbols]
            known = self.table[here, at] if not (at < 0).any() else np.full(n, _UNKNOWN, dtype=np.int32)
            if (known < 0).any():
                lost = np.flatnonzero(known < 0)
                self.learn(here[lost], symbols[lost])
                known = self.table[here, self.column[symbols]]
            deltas[k, :n] = (known & 0xFF) - 0x80
            state[:n] = known >> 8
        return state

    def count(self, pre: PreTokens) -> np.ndarray:
        """Tokens of each text of the batch, special strings included.

        A whole pre-token leads from the first state to the first state, so its map is a number; the numbers met
        so far are kept by the pre-token's hash, and only new pre-tokens run through the states.
        """
        if not len(pre.data):
            return pre.special
        start, end, hashes, which = pre.distinct()
        at = np.minimum(np.searchsorted(self.seen, hashes), len(self.seen) - 1)
        old = self.seen[at] == hashes
        found = np.where(old, self.found[at], 0).astype(np.int64)
        if not old.all():
            new = ~old
            size = end[new] - start[new]
            where = np.repeat(start[new] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            deltas = self.deltas(pre.data[where], pre.last[where])
            found[new] = np.add.reduceat(deltas, np.cumsum(size) - size)
            if len(self.seen) > self.most_seen:
                self.seen, self.found = self.seen[:1], self.found[:1]
            place = np.searchsorted(self.seen, hashes[new])
            self.seen = np.insert(self.seen, place, hashes[new])
            self.found = np.insert(self.found, place, np.minimum(found[new], 2**31 - 1))
        sums = np.concatenate(([0], np.cumsum(found[which])))
        words = np.concatenate(([0], np.cumsum(pre.last)))[pre.first]
        return sums[words[1:]] - sums[words[:-1]] + pre.special

    def deltas(self, data: np.ndarray, last: np.ndarray, chunk: int = 0) -> np.ndarray:
        """Tokens added by each byte of a stream of pre-tokens: chunks in lockstep, then a prefix scan over their maps."""
        n = len(data)
        if len(self.states) > self.most_states:
            self.reset()
        stream = data.astype(np.int64) + 256 * last
        chunk = chunk or max(64, int(n**0.5) // 2)
        rows = -(-n // chunk)
        start = np.arange(rows) * chunk
        stop = np.minimum(start + chunk, n)
        ends = np.flatnonzero(last)
        # body: where the chunk's map turns constant; without any pre-token end, nowhere
        at = np.searchsorted(ends, start)
        body = np.minimum(np.where(at < len(ends), ends[np.minimum(at, len(ends) - 1)] + 1, n), stop)
        body[0] = 0
        constant = (body < stop) | last[stop - 1]
        deltas = np.zeros(n, dtype=np.int64)
        exits = self._lockstep(stream, body, stop, np.zeros(rows, dtype=np.int64), deltas)
        # Prefix scan: a constant map needs no entry state, so its exit is known; others wait for the one before.
        todo, known = np.flatnonzero(body > start), constant.copy()
        while len(todo):
            ready = todo[known[todo - 1]]
            out = self._lockstep(stream, start[ready], body[ready], exits[ready - 1], deltas)
            exits[ready[~constant[ready]]] = out[~constant[ready]]
            known[ready] = True
            todo = np.setdiff1d(todo, ready, assume_unique=True)
        return deltas

    def _lockstep(self, stream: np.ndarray, start: np.ndarray, stop: np.ndarray, entry: np.ndarray, deltas: np.ndarray) -> np.ndarray:
        length = stop - start
        order = np.argsort(-length, kind="stable")
        length = length[order]
        steps = int(length[0]) if len(length) else 0
        where = start[order][None, :] + np.arange(steps)[:, None]
        inside = np.arange(steps)[:, None] < length[None, :]
        lanes = stream[np.minimum(where, len(stream) - 1)]
        got = np.zeros(lanes.shape, dtype=np.int64)
        out = np.empty(len(order), dtype=np.int64)
        out[order] = self.run(lanes, entry[order], length, got)
        deltas[where[inside]] = got[inside]
        return out


@lru_cache(maxsize=2)
def transducer(path: str) -> Transducer:
    """Compiled once in each process."""
    return Transducer(path)


def token_counts(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for each row of ``docs`` (``doc_id``, ``text``; others are ignored).

    path: a word-BPE vocabulary file that every machine has. Null and empty texts have 0 bytes and 0 tokens; a
    repeated row is counted again; an empty table gives an empty one. Special strings inside a text count one each.
    """

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        column = batch.column("text")
        n = transducer(path).count(PreTokens(column.to_pylist(), path))
        size = pc.binary_length(column).cast(pa.int64())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), size, pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return map_batches(texts(docs), work, "doc_id long, n_bytes long, n_tokens long, over_limit boolean", most=1 << 20)
