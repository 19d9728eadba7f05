"""Benchmark decontamination with generalised suffix automata over the words of test items."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import Scratch, pieces, utf8

WINDOW = 10
BLOCK_WORDS = 200_000  # item words in one automaton; more items take more passes
MIN_SPAN = 4  # words; shorter spans (items of one to three words) are reported, but stay in the text
MAX_COVERAGE = 0.5  # a text with a larger share of hit words is removed as a whole

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
# A-Z to lower case; ASCII characters other than letters and digits to a space
_NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32
                for b in range(256))
_RESULT = ("struct<n_words:bigint,n_hit:bigint,items:array<string>,runs:array<struct<s:bigint,e:bigint>>,"
           "spans:array<struct<start:bigint,end:bigint,words:bigint>>,clean:string>")


def normal_words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_NORMAL).split()


class SuffixAutomaton:
    """All word sequences inside the added items, with the items of each window.

    ``next`` maps words to states, ``length`` is the longest sequence of a state and ``link`` its
    suffix state.
    """

    def __init__(self, window: int = WINDOW):
        self.window = window
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.vocabulary: dict[bytes, int] = {}
        self.sequences: list[tuple[str, list[int]]] = []

    @classmethod
    def of(cls, fields: dict) -> SuffixAutomaton:
        automaton = cls.__new__(cls)
        vars(automaton).update(fields)
        return automaton

    def add(self, item: str, words: list[bytes]) -> None:
        codes = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]
        self.sequences.append((item, codes))
        last = 0
        for code in codes:
            last = self._extend(last, code)

    def _state(self, length: int, link: int, moves: dict[int, int]) -> int:
        self.next.append(moves)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _extend(self, last: int, code: int) -> int:
        if code in self.next[last]:
            return self._split(last, code)
        state = self._state(self.length[last] + 1, 0, {})
        while last >= 0 and code not in self.next[last]:
            self.next[last][code] = state
            last = self.link[last]
        if last >= 0:
            self.link[state] = self._split(last, code)
        return state

    def _split(self, last: int, code: int) -> int:
        """The state after ``last`` and ``code`` alone, cloned if it also holds longer sequences."""
        target = self.next[last][code]
        if self.length[target] == self.length[last] + 1:
            return target
        clone = self._state(self.length[last] + 1, self.link[target], dict(self.next[target]))
        self.link[target] = clone
        while last >= 0 and self.next[last].get(code) == target:
            self.next[last][code] = clone
            last = self.link[last]
        return clone

    def finish(self) -> SuffixAutomaton:
        """Mark the states of windows and of short items; call after the last ``add``."""
        window = self.window
        by_length = sorted(range(len(self.next)), key=self.length.__getitem__)
        self.window_state = [-1] * len(self.next)
        for state in by_length:
            if self.length[state] >= window:
                up = self.window_state[self.link[state]]
                self.window_state[state] = up if up >= 0 else state
        self.window_items: dict[int, set[str]] = {}
        self.short_items: dict[int, list[tuple[int, str]]] = {}
        for item, codes in self.sequences:
            state = 0
            for at, code in enumerate(codes, 1):
                state = self.next[state][code]
                if at >= window:
                    self.window_items.setdefault(self.window_state[state], set()).add(item)
            if len(codes) < window:
                while self.length[self.link[state]] >= len(codes):
                    state = self.link[state]
                self.short_items.setdefault(state, []).append((len(codes), item))
        self.short_state = [-1] * len(self.next)  # the nearest state, itself included, of a short item
        for state in by_length[1:]:
            self.short_state[state] = (state if state in self.short_items
                                       else self.short_state[self.link[state]])
        self.shortest = min([window, *(k for v in self.short_items.values() for k, _ in v)])
        pairs = [a * len(self.vocabulary) + b for a, s in self.next[0].items() for b in self.next[s]]
        self.pairs = np.array(sorted(pairs), np.int64)
        self.sequences = []
        return self

    def stream(self, codes: list[int], start: int, runs: list, items: set) -> None:
        """Follow the words, keeping the longest match that ends at each; collect hit runs."""
        moves, link, length, window = self.next, self.link, self.length, self.window
        state = matched = 0
        for at, code in enumerate(codes, start + 1):
            while state and code not in moves[state]:
                state = link[state]
                matched = length[state]
            state = moves[state].get(code, 0)
            matched = matched + 1 if state else 0
            if matched >= window:
                items |= self.window_items[self.window_state[state]]
                runs.append((at - window, at))
            short = self.short_state[state]
            while short >= 0:
                for size, item in self.short_items[short]:
                    if size <= matched:
                        items.add(item)
                        runs.append((at - size, at))
                short = self.short_state[link[short]]

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Runs [start, end) of hit words, possibly overlapping, and the items found.

        No match goes beyond a word pair that no item has, so only stretches of known pairs, at
        least as long as the shortest window, are streamed.
        """
        runs: list[tuple[int, int]] = []
        items: set[str] = set()
        get = self.vocabulary.get
        codes = np.array([get(w, -1) for w in words], np.int64)
        known = codes >= 0
        if known.sum() < self.shortest:
            return runs, items
        joined = known[:-1] & known[1:]
        at = np.flatnonzero(joined)
        pair = codes[at] * len(self.vocabulary) + codes[at + 1]
        if len(self.pairs):
            where = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
            joined[at] = self.pairs[where] == pair
        else:
            joined[:] = False
        # a stretch is a maximal sequence of known words whose neighbours are joined
        breaks = np.flatnonzero(~joined) + 1
        starts = np.concatenate(([0], breaks))
        ends = np.concatenate((breaks, [len(codes)]))
        fit = (ends - starts >= self.shortest) & known[starts]
        for s, e in zip(starts[fit].tolist(), ends[fit].tolist()):
            self.stream(codes[s:e].tolist(), s, runs, items)
        return runs, items


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(runs):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def item_blocks(benchmark: DataFrame, item_col: str, text_col: str, window: int,
                block_words: int) -> Iterator[SuffixAutomaton]:
    """Automata over at most about ``block_words`` words each; only one is on the driver at a time.

    Items longer than a block are cut into pieces that overlap by a window less one word.
    """
    automaton, size = SuffixAutomaton(window), 0
    items = benchmark.select(F.col(item_col).cast("string"), F.col(text_col).cast("string"))
    for item, text in items.toLocalIterator():
        words = normal_words(text.encode() if text else None)
        step = max(block_words, window)
        for at in range(0, max(1, len(words) - window + 1), step):
            piece = words[at:at + step + window - 1]
            if item is None or not piece:
                continue
            if size and size + len(piece) > block_words:
                yield automaton.finish()
                automaton, size = SuffixAutomaton(window), 0
            automaton.add(item, piece)
            size += len(piece)
    yield automaton.finish()


def _pass(shared, last: bool, min_span: int, max_coverage: float):
    def scan(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        automaton = SuffixAutomaton.of(shared.value)
        for column, earlier in pieces(columns):
            rows = []
            for raw, before in zip(utf8(column), earlier.to_pylist()):
                words = normal_words(raw)
                runs, items = automaton.hits(words)
                if before:
                    runs += [(r["s"], r["e"]) for r in before["runs"]]
                    items |= set(before["items"])
                runs = merged(runs)
                n_hit = sum(e - s for s, e in runs)
                row = {"n_words": len(words), "n_hit": n_hit, "items": sorted(items),
                       "runs": [{"s": s, "e": e} for s, e in runs], "spans": [], "clean": None}
                if last and runs:
                    row |= _removal(raw.decode(), runs, n_hit > max_coverage * len(words), min_span)
                rows.append(row)
            yield pa.array(rows, _ARROW)
    return scan


_ARROW = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())),
                    ("runs", pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))),
                    ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()),
                                                  ("words", pa.int64())]))),
                    ("clean", pa.string())])


def _removal(text: str, runs: list[tuple[int, int]], whole: bool, min_span: int) -> dict:
    """Spans in code points, and the text without those that exceed the limits."""
    spans, kept, at, wanted = [], [], 0, iter(runs)
    s, e = next(wanted)
    begin = 0
    for number, word in enumerate(_WORD.finditer(text)):
        if number == s:
            begin = word.start()
        if number == e - 1:
            spans.append({"start": begin, "end": word.end(), "words": e - s})
            if e - s >= min_span:
                kept.append(text[at:begin])
                at = word.end()
            s, e = next(wanted, (-1, -1))
            if s < 0:
                break
    return {"spans": spans, "clean": "" if whole else "".join(kept) + text[at:]}


def decontaminate(documents: DataFrame, benchmark: DataFrame, text_col: str = "text",
                  item_id_col: str = "item_id", item_text_col: str = "text",
                  result_col: str = "decontamination", window: int = WINDOW,
                  block_words: int = BLOCK_WORDS, min_span: int = MIN_SPAN,
                  max_coverage: float = MAX_COVERAGE) -> DataFrame:
    """``documents`` with a struct column: n_words, n_hit, items, spans, contaminated, clean.

    Words are runs of letters, digits and characters beyond ASCII, with A-Z in lower case. A
    window is ``window`` consecutive words of an item, or all words of a shorter one. Words inside
    an occurrence of a window are hit. ``items`` holds the distinct ids (as text, sorted) of items
    with a window in the text, ``spans`` the hit stretches in code points, and ``clean`` the text
    without spans of ``min_span`` words or more; it is empty where more than ``max_coverage`` of
    the words are hit, and the unchanged text where none are.

    Null and empty texts have no words and no hits, and stay as they are. Items without an id or
    words are passed over; repeated items count once. Empty tables give no rows, or no hits. Other
    columns stay; one named as ``result_col`` is replaced.

    Each automaton is built from a bounded number of item words and broadcast; a larger benchmark
    takes one pass over the documents for each, written to the shared folder in between.
    """
    spark = documents.sparkSession
    names = [c for c in documents.columns if c != result_col]
    state = documents.select(*names, F.lit(None).cast(_RESULT).alias(result_col))
    scratch, held = Scratch(spark, "decontamination"), None
    blocks = item_blocks(benchmark, item_id_col, item_text_col, window, block_words)
    automaton = next(blocks)
    while automaton is not None:
        following = next(blocks, None)
        scan = F.arrow_udf(_pass(spark.sparkContext.broadcast(vars(automaton)), following is None,
                                 min_span, max_coverage), _RESULT)
        state = state.withColumn(result_col, scan(F.col(text_col).cast("string"), F.col(result_col)))
        if following is not None:
            saved = scratch.save(state, "state")
            if held is not None:
                scratch.drop(held)
            state = held = saved
        automaton = following
    found = F.col(result_col)
    return state.withColumn(result_col, F.struct(
        found["n_words"].alias("n_words"), found["n_hit"].alias("n_hit"),
        found["items"].alias("items"), found["spans"].alias("spans"),
        (found["n_hit"] > 0).alias("contaminated"),
        F.coalesce(found["clean"], F.col(text_col).cast("string")).alias("clean")))
