"""Noisy-channel deobfuscation and toxicity scores."""

from __future__ import annotations

import itertools
import math
import re
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, held_out, per_worker, release

# What a symbol may stand for.
LEET = {
    "0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e",
}
GAPS = " .-_*"
SIGNS = "".join(c for c in LEET if not c.isalnum())
#: Costs of the channel, in nats: a symbol for a letter, a symbol as itself, a gap taken out, a repeat taken out.
SUBSTITUTE, ITSELF, GAP, REPEAT = 0.7, 1.2, 0.2, 0.1
START, END, OTHER = "\x02", "\x03", "\x01"
#: Counts of n-grams lie in so many slots by hash, however many scripts a corpus has; each letter counts by itself.
SLOTS = 1 << 20

#: Labelled rows to learn from at most, by class: those with the least hash of their id.
MAX_TOXIC, MAX_CLEAN = 4000, 8000
STEM_LENGTHS = (4, 5, 6, 7, 8)
LEAST_DOCS, LEAST_SHARE = 3, 0.8
#: Different tokens of a text that share a beginning are counted up to so many, behind a sign that no stem has.
MANY, TIMES = 3, "\x03"
#: From this P(toxic | stem) on, or if no clean text has it, a sure stem is in the lexicon whatever else explains its texts.
CLEAR_SHARE = 0.95
TELLING = 3
#: Marks of a text by which copies are known, and the chance of any stem's being sure by accident.
MARKS, CHANCE = 8, 0.05

_SYM = "".join(map(re.escape, LEET))
#: A token that may hide a word: symbols beside letters, a letter three times, single letters with gaps.
ODD = re.compile(rf"[^\W\d_][{_SYM}]+[^\W\d_]|^[{_SYM}][^\W\d_]{{2}}|([^\W\d_])\1\1|(?<![^\W\d_])[^\W\d_](?:[.\-_*][^\W\d_](?![^\W\d_])){{2,}}")
#: A token that may be a slighter disguise: a symbol at a letter, a letter twice, single characters with gaps.
SLIGHT = re.compile(rf"[^\W\d_][{_SYM}]|[{_SYM}][^\W\d_]|([^\W\d_])\1|(?<![^\W\d_])(?:[^\W\d_]|[{_SYM}])(?:[.\-_*](?:[^\W\d_]|[{_SYM}])(?![^\W\d_])){{2,}}")
#: Three or more chunks of one or two characters, parted by any white space.
SHORT = re.compile(r"(?<!\S)(?:\S{1,2}\s+){2,}\S{1,2}(?!\S)")
#: Four or more single characters with one space each between them.
SPACED = re.compile(r" (?:\S ){3,}\S(?!\S)")
RUN = re.compile(r"(.)\1{3,}", re.S)
LETTERS = re.compile(r"[^\W\d_]+")


class Slots:
    """Counts of n-grams by hash; those that share a slot share its count."""

    def __init__(self, counts: np.ndarray):
        self.counts = counts

    def get(self, gram: str, default: int = 0) -> int:
        return int(self.counts[zlib.crc32(gram.encode("utf-8", "surrogatepass")) % len(self.counts)])


class CharModel:
    """Interpolated character trigrams within words.

    grams are counts, a dict or Slots; with an alphabet, letters beyond it are one symbol.  letters and total are the
    number of different letters and of all single symbols, where they can't be told from grams.
    """

    def __init__(self, grams, alphabet: str | None = None, letters: int | None = None, total: int | None = None):
        self.grams, self.alphabet = grams, None if alphabet is None else frozenset(alphabet)
        self.letters = len(self.alphabet) if letters is None else letters
        self.total = max(1, sum(c for g, c in grams.items() if len(g) == 1) if total is None else total)
        self.known: dict[tuple[str, str], float] = {}

    def logp(self, context: str, c: str) -> float:
        """log P(c | the last two characters)."""
        c = c if c == END else self.folded(c)
        got = self.known.get((context, c))
        if got is None:
            g = self.grams.get
            uni = (g(c, 0) + 0.1) / (self.total + 0.1 * (self.letters + 2))
            bi = (g(context[-1] + c, 0) + 4 * uni) / (g(context[-1], 0) + 4)
            tri = (g(context + c, 0) + 4 * bi) / (g(context, 0) + 4)
            got = self.known[(context, c)] = math.log(tri)
        return got

    def folded(self, c: str) -> str:
        return c if self.alphabet is None or c in self.alphabet else OTHER


def word_grams(counts: Counter) -> Counter:
    """Uni-, bi- and trigram counts of the letter runs of counted tokens, with starts and an end."""
    runs: Counter = Counter()
    for token, n in counts.items():
        for w in (token,) if token.isalpha() else LETTERS.findall(token):
            runs[w] += n
    if not runs:
        return Counter()
    joined = "".join(f"{START}{START}{w}{END}" for w in runs)
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    weight = np.repeat(np.fromiter(runs.values(), np.int64, len(runs)), np.fromiter(map(len, runs), np.int64, len(runs)) + 3)
    out: Counter = Counter({START: int(sum(runs.values())), START + START: int(sum(runs.values()))})
    own = code != ord(START)  # n-grams end in a letter or an end, and so lie within one run
    there = np.zeros(int(code.max()) + 1, bool)
    there[code] = True
    letters, code = np.flatnonzero(there), (np.cumsum(there) - 1)[code]
    base, key = len(letters), code.copy()
    for width in range(1, 4):
        if width > 1:
            key = key + np.concatenate((np.zeros(width - 1, np.int64), code[: 1 - width])) * base ** (width - 1)
        if base**width <= 1 << 24:
            totals = np.bincount(key[own], weights=weight[own])
            grams = np.flatnonzero(totals)
            totals = totals[grams]
        else:
            grams, at = np.unique(key[own], return_inverse=True)
            totals = np.bincount(at, weights=weight[own])
        shown = [letters[grams // base**k % base].tolist() for k in range(width - 1, -1, -1)]
        for g, n in zip(zip(*shown, strict=True), totals.tolist(), strict=True):
            out["".join(map(chr, g))] += int(n)
    return out


def gram_counts(docs: DataFrame) -> DataFrame:
    """(gram, n) over the lower-cased words of all texts, added up in each task before the shuffle."""

    def run(batches):
        per_worker(None, None)
        words: Counter = Counter()
        grams: Counter = Counter()
        for b in batches:
            for t in b["text"]:
                if t:
                    words.update(t.lower().split())
                if len(words) > 100_000:
                    grams.update(word_grams(words))
                    words = Counter()
            if len(grams) > 200_000:
                yield pd.DataFrame({"gram": list(grams), "n": list(grams.values())})
                grams = Counter()
        grams.update(word_grams(words))
        yield pd.DataFrame({"gram": list(grams), "n": list(grams.values())}).astype({"gram": object, "n": "int64"})

    return docs.select("text").mapInPandas(run, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def char_model(docs: DataFrame, slots: int = SLOTS) -> CharModel:
    """The character model of all texts: every letter of every script counts by itself.

    The driver gets a count for each slot at most, whatever the input; n-grams of one slot share it, which blurs the
    counts of rare ones where there are more kinds than slots.
    """
    counts = cut_lineage(gram_counts(docs))
    by_slot = counts.groupBy((F.crc32(F.col("gram").cast("binary")) % slots).cast("int").alias("slot")).agg(F.sum("n").alias("n")).toPandas()
    single = F.length("gram") == 1
    letters, total = counts.agg(F.count_if(single & ~F.col("gram").isin(START, END)), F.coalesce(F.sum(F.when(single, F.col("n"))), F.lit(0))).first()
    release(counts)
    table = np.zeros(slots, np.int64)
    table[by_slot["slot"].to_numpy(np.int64)] = by_slot["n"].to_numpy(np.int64)
    return CharModel(Slots(table), letters=letters, total=total)


class Arcs(dict):
    """What the channel makes of a character: (what it may give and at which cost, repeats go, gap goes, cost of an end).

    A letter gives itself; a symbol gives itself or a letter it stands for, and one that is no digit may end
    the word; a gap gives nothing or ends the word; other characters end the word (cost None: they can't).
    Letters and symbols that repeat the character before may give nothing.
    """

    def __missing__(self, c: str):
        if c in LEET:
            gives = tuple((x, SUBSTITUTE) for x in LEET[c]) + (((c, ITSELF),) if c.isalnum() else ())
        else:
            gives = ((c, 0.0),) if c.isalnum() else ()
        end = None if c.isalnum() else ITSELF if c in LEET else 0.0
        self[c] = got = (gives, c.isalpha() or c in LEET, c in GAPS, end)
        return got


ARCS = Arcs()


def decode(chunk: str, lm: CharModel) -> str:
    """The likeliest reading of a chunk: exact Viterbi over its character lattice.

    A state is the last two characters given, all that the character model looks at, and every state is
    kept.  A run of over three equals a run of three.
    """
    chunk = RUN.sub(lambda m: m[1] * 3, chunk)
    begin = START + START
    logp, folded = lm.logp, lm.folded
    states: dict[str, tuple[float, tuple | None]] = {begin: (0.0, None)}
    last = ""
    for c in chunk:
        gives, repeats, gap, end = ARCS[c]
        gives = [(x, folded(x), cost) for x, cost in gives]
        repeats = repeats and c == last
        step: dict[str, tuple[float, tuple | None]] = {}
        for state, (score, path) in states.items():
            for x, own, cost in gives:
                to, value = state[1] + own, score + logp(state, x) - cost
                if to not in step or step[to][0] < value:
                    step[to] = (value, (x, path))
            if repeats and state != begin:
                value = score - REPEAT
                if state not in step or step[state][0] < value:
                    step[state] = (value, path)
            if end is not None:
                if gap:
                    value = score - GAP
                    if state not in step or step[state][0] < value:
                        step[state] = (value, path)
                if state == begin:
                    value, path = score - end, (c, path) if path and path[0] != " " else path
                else:
                    value, path = score + logp(state, END) - end, (" ", path)
                if begin not in step or step[begin][0] < value:
                    step[begin] = (value, path)
        states, last = step, c
    best = max(states.items(), key=lambda x: (x[1][0] + (logp(x[0], END) if x[0] != begin else 0), x[0]))[1][1]
    out = []
    while best:
        out.append(best[0])
        best = best[1]
    return "".join(reversed(out)).strip()


class Skeleton(dict):
    """A table for str.translate: letters and symbols that may stand for each other become one, the rest goes."""

    def __init__(self):
        same = {c: c for c in {*LEET, *"".join(LEET.values())}}
        for _ in same:  # long enough for any chain
            for c, letters in LEET.items():
                low = min(same[x] for x in (c, *letters))
                same.update({x: low for x in (c, *letters)})
        super().__init__({ord(c): x for c, x in same.items()} | {0: "\0"})

    def __missing__(self, code: int) -> str:
        self[code] = got = chr(code) if chr(code).isalnum() else ""
        return got


SKELETON = Skeleton()


def skeletons(tokens: list[str]) -> str:
    """Skeletons of tokens, with no character twice in a row, each with a zero character after it.

    Whatever a token's lattice reads, the skeleton of a word of it, or of a word's beginning, is part of the
    token's skeleton: gaps are left out and repeats come once in both.
    """
    joined = ("\0".join(t.replace("\0", "") for t in tokens) + "\0").translate(SKELETON)
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    new = np.append(True, code[1:] != code[:-1]) | (code == 0)
    return code[new].tobytes().decode("utf-32-le", "surrogatepass")


class Restorer:
    """Restored texts and tokens; recent chunks' readings are kept."""

    def __init__(self, lm: CharModel):
        self.lm, self.kept = lm, {}

    def read(self, chunk: str) -> str:
        got = self.kept.get(chunk)
        if got is None:
            if len(self.kept) > 50_000:
                self.kept.clear()
            got = self.kept[chunk] = decode(chunk, self.lm)
        return got

    def spaced(self, text: str | None) -> str:
        """The lower-cased text with runs of single characters read as words."""
        return SPACED.sub(lambda m: " " + self.read(m[0]), f" {(text or '').lower()} ")

    def token(self, token: str) -> str:
        return self.read(token) if ODD.search(token) else token

    def readings(self, token: str) -> tuple[str, ...]:
        """What a token may say: its decoded form, and itself too where it is at most a slight disguise."""
        if ODD.search(token):
            return (self.read(token),)
        return (token, self.read(token)) if SLIGHT.search(token) else (token,)

    def short_runs(self, text: str | None) -> set[str]:
        """Runs of short chunks of the lower-cased text, with single spaces."""
        return {" ".join(m.split()) for m in SHORT.findall((text or "").lower())}

    def restore(self, text: str | None) -> str:
        """The lower-cased text with suspect chunks decoded and white space as single spaces."""
        return " ".join(map(self.token, self.spaced(text).split()))


def token_stems(restored: str) -> set[str]:
    """Words marked by '=', and their beginnings, of a restored token."""
    out = set()
    for w in (restored,) if restored.isalpha() else LETTERS.findall(restored):
        out.add("=" + w)
        out.update(w[:n] for n in STEM_LENGTHS if len(w) > n)
    return out


def often(counts: Counter) -> set[str]:
    """Stems, and beginnings that several different tokens of a text share also with their number, up to MANY."""
    out = set(counts)
    for s, n in counts.items():
        if n > 1 and s[0] != "=":
            out.update(f"{s}{TIMES}{k}" for k in range(2, min(n, MANY) + 1))
    return out


class Reader:
    """Stems of whole texts that a wanted set holds; each distinct token is restored and looked up once.

    Tokens that may be slight disguises and runs of short chunks count as written and as decoded.  A word of split,
    some of the wanted, in two or more pieces, parted by white space anywhere, is read as one chunk.  Where stems
    are wanted, only tokens whose skeleton holds that of one are read: no reading of the others has any.
    """

    MOST = 100_000

    def __init__(self, lm: CharModel, wanted=None, split=()):
        self.restorer, self.wanted = Restorer(lm), None if wanted is None else set(wanted)
        self.bare = None if wanted is None else {w.split(TIMES)[0] for w in self.wanted}
        self.seen: set[str] = set()
        self.hits: dict[str, set[str]] = {}
        self.machine = None
        # Skeletons of words that may come in pieces, their beginnings, and tokens that are such a beginning, with their skeletons.
        self.words: set[str] = set()
        self.beginnings: set[str] = set()
        self.openers: dict[str, str] = {}
        if self.wanted:
            import ahocorasick

            self.words = set(skeletons([w[1:] for w in split if w[0] == "="]).split("\0")) - {""}
            self.beginnings = {w[:n] for w in self.words for n in range(1, len(w))}
            self.machine = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
            for s in skeletons([w.lstrip("=") for w in sorted(self.bare)]).split("\0"):
                if s:
                    self.machine.add_word(s)
            self.machine.make_automaton()

    def suspects(self, tokens: list[str]) -> list[str]:
        """Tokens that may read as something with a wanted stem."""
        if self.wanted is None:
            return tokens
        if not self.machine or not tokens:
            return []
        shapes = skeletons(tokens)
        self.openers.update((t, s) for t, s in zip(tokens, shapes.split("\0")[:-1], strict=True) if s in self.beginnings)
        ends = np.flatnonzero(np.frombuffer(shapes.encode("utf-32-le", "surrogatepass"), np.uint32) == 0)
        at = np.fromiter((e for e, _ in self.machine.iter(shapes)), np.int64)
        return [tokens[i] for i in np.unique(np.searchsorted(ends, at)).tolist()]

    def split_words(self, tokens: list[str]) -> set[str]:
        """Runs of tokens, pieces of any length, whose skeletons make up that of a wanted word together."""
        out = set()
        for i in [i for i, t in enumerate(tokens) if t in self.openers]:
            whole = self.openers[tokens[i]]
            for j in range(i + 1, len(tokens)):
                # Signs at a word's end may be letters or not.
                more, short = skeletons([tokens[j], tokens[j].rstrip(SIGNS)]).split("\0")[:2]
                bare = whole + (short[1:] if short and whole[-1] == short[0] else short)
                whole += more[1:] if more and whole[-1] == more[0] else more
                if whole in self.words or bare in self.words:
                    out.add(" ".join(tokens[i : j + 1]))
                if whole not in self.beginnings:
                    break
        return out

    def look_up(self, fresh: list[str]) -> None:
        """Notes the wanted stems of tokens that haven't been met."""
        for t in self.suspects(fresh):
            read = (self.restorer.read(t),) if " " in t else self.restorer.readings(t)
            got = set().union(*(token_stems(w) for r in read for w in r.split()))
            if self.bare is not None:
                got &= self.bare
            if got:
                self.hits[t] = got
        self.seen.update(fresh)

    def stems(self, text: str | None) -> set[str]:
        # A run holds a space, so it is never one of the tokens.
        listed = self.restorer.spaced(text).split()
        tokens = set(listed) | self.restorer.short_runs(text)
        if len(self.seen) > self.MOST:
            self.seen, self.hits, self.openers = set(), {}, {}
        self.look_up(list(tokens - self.seen))
        if self.openers and (runs := self.split_words(listed)):
            self.look_up(list(runs - self.seen))
            tokens |= runs
        counts: Counter = Counter()
        for t in tokens & self.hits.keys():
            counts.update(self.hits[t])
        return often(counts) if self.wanted is None else often(counts) & self.wanted


def stem_odds(toxic: dict[str, int], clean: dict[str, int], n_toxic: int, n_clean: int, share: float) -> dict[str, float]:
    """P(toxic | stem) of stems where it reaches LEAST_SHARE, from document counts of either class."""
    out = {}
    for s, t in toxic.items():
        a, b = share * t / n_toxic, (1 - share) * (clean.get(s, 0) + 0.5) / (n_clean + 1)
        if t >= LEAST_DOCS and a / (a + b) >= LEAST_SHARE:
            out[s] = a / (a + b)
    return out


def greedy_lexicon(toxic: list[list[str]], odds: dict[str, float]) -> dict[str, float]:
    """Stem -> P(toxic | stem), chosen one by one so that each explains toxic texts no earlier one does.

    That keeps the words that copies of a toxic text happen to share out of it.
    """
    holders: dict[str, set[int]] = {}
    for i, t in enumerate(toxic):
        for s in t:
            holders.setdefault(s, set()).add(i)
    out = {}
    while holders:
        best = max(holders, key=lambda s: (len(holders[s]), odds[s], len(s), s))
        gone = holders.pop(best)
        if len(gone) < LEAST_DOCS:
            break
        out[best] = odds[best]
        for s in [s for s, h in holders.items() if not h.isdisjoint(gone)]:
            holders[s] = holders[s] - gone
            if len(holders[s]) < LEAST_DOCS:
                del holders[s]
    return out


def text_marks(text: str | None) -> list[int]:
    """MinHashes of the shingles of a text's letters, three words wide; copies and near copies share some of them."""
    words = LETTERS.findall((text or "").lower())
    held = {" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))}
    h = np.fromiter((zlib.crc32(x.encode("utf-8", "surrogatepass")) for x in held), np.uint64, len(held))
    return [int((((h * np.uint64(2 * k + 0x9E3779B1)) & np.uint64(0xFFFFFFFF)) ^ np.uint64(k)).min()) for k in range(MARKS)]


def copy_groups(marks: list[list[int]]) -> list[int]:
    """A number for each text, one for texts that share two marks."""
    parent = list(range(len(marks)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    seen: dict[tuple, int] = {}
    for i, m in enumerate(marks):
        for j, k in itertools.combinations(range(MARKS), 2):
            parent[find(i)] = find(seen.setdefault((j, k, m[j], m[k]), i))
    return [find(i) for i in range(len(marks))]


def sure_stems(toxic: list[list[str]], groups: list[int], clean: dict[str, int], share: float, tests: int) -> set[str]:
    """Stems that toxic texts hold far too often for chance, copies of a text counting as one.

    The Chernoff bound of a binomial with share toxic, times the number of stems looked at, is under CHANCE.
    """
    holders: dict[str, set[int]] = {}
    for t, g in zip(toxic, groups, strict=True):
        for s in t:
            holders.setdefault(s, set()).add(g)
    out = set()
    for s, held in holders.items():
        n, k = len(held) + clean.get(s, 0), len(held)
        part = k / n
        if part <= share or len(held) < LEAST_DOCS:
            continue
        apart = part * math.log(part / share) + (1 - part) * (math.log((1 - part) / (1 - share)) if part < 1 else 0.0)
        if math.log(tests) - n * apart < math.log(CHANCE):
            out.add(s)
    return out


def text_score(found: set[str], lexicon: dict[str, float], base: float) -> float:
    """Noisy-or of the stems found and the share of toxic texts that have none."""
    left = 1 - base
    for s in found:
        left *= 1 - lexicon[s]
    return 1 - left


def fit(docs: DataFrame, labels: DataFrame, lm: CharModel) -> tuple[dict[str, float], float]:
    """(lexicon, score of a text without any stem of it) from labelled rows outside the held-out fold.

    The lexicon has all clear and sure stems, and those that explain the other toxic texts one by one.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg((F.avg("toxic") >= 0.5).alias("toxic"))
    known = known.where(~held_out(5, 0)).withColumn("h", F.xxhash64(F.lit(7), "doc_id"))
    some = known.where("toxic").orderBy("h").limit(MAX_TOXIC).union(known.where("not toxic").orderBy("h").limit(MAX_CLEAN)).select("doc_id", "toxic")
    n = known.agg(F.count("*").alias("n"), F.coalesce(F.count_if("toxic"), F.lit(0)).alias("t")).first()
    texts = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")  # at most MAX_TOXIC + MAX_CLEAN rows
    share = lambda x: docs.sparkSession.sparkContext.broadcast(x)
    lm_b = share(lm)

    def found(wanted):
        """Wanted stems of each text."""

        def run(batches):
            r = Reader(lm_b.value, wanted.value)
            for b in batches:
                yield pd.DataFrame({"stems": [sorted(r.stems(t)) for t in b["text"]], "marks": [text_marks(t) for t in b["text"]]})

        return run

    def counted(batches):
        """Texts of a task that have a stem; the number of texts under ''."""
        r, c, n = Reader(lm_b.value), Counter(), 0
        for b in batches:
            for t in b["text"]:
                c.update(r.stems(t))
                n += 1
                if len(c) > 200_000:
                    yield pd.DataFrame({"s": list(c), "n": list(c.values())})
                    c = Counter()
        yield pd.DataFrame({"s": ["", *c], "n": [n, *c.values()]})

    def counts(of):
        return cut_lineage(texts.where(of).mapInPandas(counted, "s string, n long").groupBy("s").agg(F.sum("n").alias("n")))

    # Only stems whose odds suffice are collected, however many there are.
    clean, toxic = counts("not toxic"), counts("toxic")
    try:
        n_clean = clean.where("s = ''").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        n_toxic, share_toxic = min(n["t"], MAX_TOXIC), (n["t"] + 0.5) / (n["n"] + 1)
        few = toxic.where((F.col("s") != "") & (F.col("n") >= LEAST_DOCS))
        tests = few.count()
        few = few.join(clean.select("s", F.col("n").alias("c")), "s", "left").select("s", "n", F.coalesce("c", F.lit(0)).alias("c"))
        a, b = F.col("n") * (share_toxic / max(1, n_toxic)), (F.col("c") + 0.5) * ((1 - share_toxic) / (n_clean + 1))
        rows = few.where(a >= (LEAST_SHARE - 1e-6) * (a + b)).collect()
    finally:
        release(clean, toxic)
    also = {r["s"]: r["c"] for r in rows}
    odds = stem_odds({r["s"]: r["n"] for r in rows}, also, n_toxic, n_clean, share_toxic)
    if not odds:
        return {}, 0.0
    read = texts.where("toxic").mapInPandas(found(share(set(odds))), "stems array<string>, marks array<long>").collect()
    held = [r["stems"] for r in read]
    sure = sure_stems(held, copy_groups([r["marks"] for r in read]), also, n_toxic / (n_toxic + n_clean + 1), tests)
    lexicon = {s: odds[s] for s in sure if odds[s] >= CLEAR_SHARE or not also[s]}
    left = [t for t in held if lexicon.keys().isdisjoint(t)]
    # Where clear stems explain most texts, the others may be wrongly labelled: stems for them must be sure too.
    lexicon |= greedy_lexicon([[s for s in t if s in sure] for t in left] if lexicon else left, odds)
    missed = sum(lexicon.keys().isdisjoint(t) for t in held) / len(held) * n["t"]
    return lexicon, min(0.4, (missed + 0.5) / (n["n"] - n["t"] + missed + 1))


def telling(lexicon: dict[str, float]) -> set[str]:
    """Stems that miss certainty at most TELLING times as far as the most telling one: others' pieces come together by chance."""
    return {s for s, p in lexicon.items() if 1 - p <= TELLING * (1 - max(lexicon.values()))}


def scorer(docs: DataFrame, labels: DataFrame):
    """A function for executors that gives a batch's scores, after fitting on docs and labels."""
    lm = char_model(docs)
    lexicon, base = fit(docs, labels, lm)
    model, key = docs.sparkSession.sparkContext.broadcast((lm, lexicon, base)), uuid.uuid4().hex

    def scores():
        lm, lexicon, base = model.value
        reader = per_worker(key, lambda: Reader(lm, lexicon.keys(), telling(lexicon)))
        return lambda texts: np.array([text_score(reader.stems(t), lexicon, base) for t in texts], dtype=float)

    return scores


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    The character model counts all texts; the lexicon learns from at most MAX_TOXIC + MAX_CLEAN labelled
    rows.  Null and empty texts score as texts without a stem of the lexicon; a null id is not held out;
    repeated rows repeat; conflicting labels of one id count as their mean, ties as toxic; without toxic labels
    every score is 0.  Other columns are ignored; a very long text is read whole; an empty table gives no rows.
    """
    scores = scorer(docs, labels)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        score = scores()
        for b in batches:
            s = score(b["text"])
            yield pd.DataFrame({"doc_id": b["doc_id"], "held_out": b["held_out"], "score": s, "predicted": (s >= 0.5).astype("int32")})

    return docs.select("doc_id", held_out(5, 0).alias("held_out"), "text").mapInPandas(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows predicted toxic, all columns kept, in one pass over them after fitting."""
    scores = scorer(docs, labels)
    score = F.pandas_udf(_series_score(scores), "double")
    return docs.where(score("text") < 0.5)


def _series_score(scores):
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        score = scores()
        for p in parts:
            yield pd.Series(score(p), index=p.index)

    run.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return run
