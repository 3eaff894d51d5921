"""Suffix-array repetition rules over the words of a text."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks

#: Repeats below this many words don't count as maximal repeats of the rule.
MIN_REPEAT = 8
#: A text is kept while its maximal repeats cover at most this share of its words, below the half that the base
#: rule already rejects (words under repeats of MIN_REPEAT words also lie in windows found again) ...
MAX_COVERED = 0.25
#: ... and none is longer than this many words.
MAX_LONGEST = 50
MIN_WORDS = 50
WINDOW = 3
SYMBOLS = b"#*$%&|<>"
BLANK = b" \t\n\x0b\x0c\r"


def suffix_order(ids: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(suffix array, ranks by 1, 2, 4, ... leading symbols) by prefix doubling.

    A rank is the place of its group's first suffix, so a suffix that has become unique keeps its rank and
    only those still tied are sorted again.  Suffixes must differ somewhere: end each text by a symbol of
    its own.
    """
    n = len(ids)
    order = np.argsort(ids, kind="stable")
    new = np.ones(n, bool)
    new[1:] = ids[order][1:] != ids[order][:-1]
    first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = first
    ranks, step = [rank], 1
    tied = ~(new & np.append(new[1:], True))
    while tied.any():
        at = np.flatnonzero(tied)
        who = order[at]
        second = np.where(who + step < n, ranks[-1][np.minimum(who + step, n - 1)], -1)
        group = first[at]
        by = np.argsort(group * (n + 1) + second + 1, kind="stable")
        who, second = who[by], second[by]
        order[at] = who
        fresh = np.ones(len(at), bool)
        fresh[1:] = (group[1:] != group[:-1]) | (second[1:] != second[:-1])
        start = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
        first[at] = at[start]
        rank = ranks[-1].copy()
        rank[who] = first[at]
        ranks.append(rank)
        tied = np.zeros(n, bool)
        tied[at] = ~(fresh & np.append(fresh[1:], True))
        step *= 2
    return order, ranks


def common_prefixes(order: np.ndarray, ranks: list[np.ndarray]) -> np.ndarray:
    """Longest common prefix of each suffix and the one before it in the order; 0 for the first."""
    n = len(order)
    lcp = np.zeros(n, np.int64)
    if n < 2:
        return lcp
    live = np.flatnonzero(ranks[0][order[1:]] == ranks[0][order[:-1]]) + 1
    i, j, got = order[live - 1].copy(), order[live].copy(), np.zeros(len(live), np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        inside = (i < n) & (j < n)
        same = inside & (ranks[k][np.minimum(i, n - 1)] == ranks[k][np.minimum(j, n - 1)])
        gain = np.where(same, 1 << k, 0)
        i, j, got = i + gain, j + gain, got + gain
    lcp[live] = got
    return lcp


def lcp_intervals(lcp, start: int = 0) -> list[tuple[int, int, int]]:
    """(length, first, last) of every LCP interval with a positive length, inner ones before outer ones; places count from start."""
    lcp = lcp.tolist() if isinstance(lcp, np.ndarray) else lcp
    out, stack = [], [(0, 0)]
    for i in range(1, len(lcp) + 1):
        here = lcp[i] if i < len(lcp) else 0
        left = i - 1
        while stack[-1][0] > here:
            length, left = stack.pop()
            out.append((length, start + left, start + i - 1))
        if stack[-1][0] < here:
            stack.append((here, left))
    return out


def maximal_intervals(order: np.ndarray, lcp: np.ndarray, before: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(length, first, last) of the LCP intervals of at least `least` that are maximal repeats, inner ones first.

    before is the symbol before each place.  An interval whose suffixes all follow one symbol could be extended to the
    left, and is left out.  Only stretches of the order where common prefixes are long enough are walked.
    """
    long = lcp >= least
    edges = np.flatnonzero(np.diff(np.concatenate(([False], long, [False])).astype(np.int8)))
    found = []
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        # The stretch begins with the suffix before the first long prefix, which has none here.
        found += lcp_intervals([0, *lcp[a:b].tolist()], a - 1)
    if not found:
        return (np.zeros(0, np.int64),) * 3
    length, first, last = np.array([f for f in found if f[0] >= least] or np.zeros((0, 3)), np.int64).T
    follows = before[order]
    changes = np.concatenate(([0], np.cumsum(follows[1:] != follows[:-1])))
    keep = changes[last] > changes[first]
    return length[keep], first[keep], last[keep]


def spans_of(order: np.ndarray, length: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """For each place, the length of the longest maximal repeat that begins there; 0 for none.

    Intervals come inner ones first, and a place belongs to the innermost: what outer ones have of it is shorter.
    """
    reach, free = np.zeros(len(order), np.int64), {}
    order = order.tolist()
    for n, a, b in zip(length.tolist(), first.tolist(), last.tolist(), strict=True):
        at = a
        while at <= b:
            # Places that are taken are stepped over together.
            if at in free:
                step = at
                while step in free:
                    step = free[step]
                while at in free and at != step:
                    free[at], at = step, free[at]
                at = step
                continue
            reach[order[at]] = n
            free[at] = at + 1
            at += 1
    return reach


def maximal_repeats(words: list, min_repeat: int = 1) -> list[tuple[int, tuple[int, ...]]]:
    """(length, places) of every maximal repeat of at least min_repeat words, longest first."""
    known: dict = {}
    ids = np.array([known.setdefault(w, len(known)) for w in words] + [len(words)], dtype=np.int64)
    order, ranks = suffix_order(ids)
    length, first, last = maximal_intervals(order, common_prefixes(order, ranks), before_each(ids, np.zeros(1, np.int64)), min_repeat)
    out = [(n, tuple(sorted(order[a : b + 1].tolist()))) for n, a, b in zip(length.tolist(), first.tolist(), last.tolist(), strict=True)]
    return sorted(out, key=lambda r: (-r[0], r[1]))


def before_each(ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The symbol before each place; the first place of a text has one of its own."""
    before = np.concatenate(([-1], ids[:-1]))
    before[starts] = -1 - np.arange(len(starts))
    return before


def repeats_of(texts: list[str], min_repeat: int, window: int):
    """By text: words, words under windows found again, words under maximal repeats, longest repeat, and each place's longest maximal repeat."""
    known: dict[bytes, int] = {}
    words, sizes = [], np.empty(len(texts), np.int64)
    for k, t in enumerate(texts):
        w = t.encode("utf-8", "surrogatepass").split()
        sizes[k] = len(w)
        words.extend([known.setdefault(x, len(known)) for x in w])
        words.append(-1)
    ids = np.array(words, dtype=np.int64)
    ends = np.cumsum(sizes + 1)
    ids[ends - 1] = len(known) + np.arange(len(texts))
    # One suffix array holds all texts: places are set apart by text, so that repeats are sought within one.
    owner = np.repeat(np.arange(len(texts)), sizes + 1)
    _, local = np.unique(owner * (len(known) + len(texts) + 1) + ids, return_inverse=True)
    order, ranks = suffix_order(local)
    lcp = common_prefixes(order, ranks)
    starts = ends - sizes - 1
    # Words of a window found again: each place with as long a prefix in common with a neighbour of the order.
    again = np.empty(len(ids), np.int64)
    again[order] = np.maximum(lcp, np.append(lcp[1:], 0))
    reach = spans_of(order, *maximal_intervals(order, lcp, before_each(local, starts), min_repeat))

    def covered(reach: np.ndarray, least: int) -> np.ndarray:
        at = np.flatnonzero(reach >= least)
        edge = np.bincount(at, minlength=len(ids) + 1) - np.bincount(at + reach[at], minlength=len(ids) + 1)
        return np.add.reduceat((np.cumsum(edge)[: len(ids)] > 0).astype(np.int64), starts)

    # The longest interval of a text is always a maximal repeat.
    return sizes, covered(again, window), covered(reach, min_repeat), np.maximum.reduceat(again, starts), [reach[a : a + n] for a, n in zip(starts.tolist(), sizes.tolist(), strict=True)]


def merged(reach: np.ndarray) -> list[dict]:
    """The union of a text's maximal repeats as spans of words: first and end."""
    at = np.flatnonzero(reach)
    if not len(at):
        return []
    end = np.maximum.accumulate(at + reach[at])
    cut = np.flatnonzero(np.concatenate(([True], at[1:] > end[:-1])))
    return [{"first": a, "end": b} for a, b in zip(at[cut].tolist(), end[np.append(cut[1:] - 1, len(at) - 1)].tolist(), strict=True)]


def text_rules(texts: list[str | None], min_repeat: int = MIN_REPEAT, max_covered: float = MAX_COVERED, max_longest: int = MAX_LONGEST, spans: list | None = None) -> dict[str, np.ndarray]:
    """Counts and verdicts of texts, an array for each result column; spans, a list, gets each text's spans under repeats."""
    texts = [t or "" for t in texts]
    cols: dict[str, list] = {"n_words": [], "n_repeat_words": [], "covered_words": [], "longest_repeat": []}
    for a, b in chunks(texts):
        *counts, reach = repeats_of(texts[a:b], min_repeat, WINDOW)
        for name, values in zip(cols, counts, strict=True):
            cols[name].append(values)
        if spans is not None:
            spans += [merged(r) for r in reach]
    out = {k: np.concatenate(v) if v else np.zeros(0, np.int64) for k, v in cols.items()}
    chars, symbols, dups = (np.zeros(len(texts), np.int64) for _ in range(3))
    for i, t in enumerate(texts):
        raw = t.encode("utf-8", "surrogatepass")
        chars[i] = len(t) - (len(raw) - len(raw.translate(None, BLANK)))
        symbols[i] = len(raw) - len(raw.translate(None, SYMBOLS))
        if b"\n" in raw:
            lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
            dups[i] = len(lines) - len(set(lines))
    n = out["n_words"]
    failed = (n < MIN_WORDS) | (100 * out["n_repeat_words"] > 50 * n)
    fine = (out["covered_words"] <= max_covered * n) & (out["longest_repeat"] <= max_longest)
    return out | {"word_chars": chars, "n_symbols": symbols, "n_dup_lines": dups, "base_failed": failed, "kept": ~failed & fine}


COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat", "base_failed", "kept")


def repetition_rules(docs: DataFrame, min_repeat: int = MIN_REPEAT, max_covered: float = MAX_COVERED, max_longest: int = MAX_LONGEST, id_col: str = "doc_id", text_col: str = "text", spans: bool = False) -> DataFrame:
    """One row per document with its counts, base_failed and kept; with spans also the stretches under maximal repeats.

    Words are split at ASCII white space.  Maximal repeats are LCP intervals of at least min_repeat words of a suffix
    array that can be extended neither way; overlapping occurrences count.  kept is false if the base rule fails, if
    the union of their spans covers over max_covered of the words, or if one has over max_longest words.  spans:
    array of (first, end), places of words, in order and apart.  Null and empty texts have no words and fail the
    base rule; a text that is the same word all over is one repeat; null ids and repeated rows are kept as they
    come; other columns are ignored; an empty table gives no rows.  The work is per row, a very long text
    included: no shuffle.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = ", ".join([f"doc_id {kind}"] + [f"{c} {'boolean' if c in ('base_failed', 'kept') else 'long'}" for c in COLUMNS] + ["spans array<struct<first:long,end:long>>"] * spans)

    def run(batches):
        for b in batches:
            found = [] if spans else None
            rules = text_rules(list(b["text"]), min_repeat, max_covered, max_longest, found)
            out = pd.DataFrame({"doc_id": b["doc_id"]} | {c: rules[c] for c in COLUMNS})
            yield out.assign(spans=found) if spans else out

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(run, schema)
