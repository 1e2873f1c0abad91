"""Token counts by rank-synchronous array merging.

Pre-tokens of a whole batch lie in one ragged numpy array. In each round every sequence looks up its neighbouring pairs,
takes its pair of lowest rank and merges it, all sequences at once; a sequence without a known pair is done. A very long
sequence has rounds of its own, and finds its pairs of lowest rank in lists of positions kept by rank instead of by a look
at all of its symbols; the merges are the same. Symbols that survive are counted, a character outside the vocabulary
as its UTF-8 bytes.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from millrace.llm.common import encoded, pick, read, text_map

VOCABULARY = "piece_bpe_32k.model"
OVER_LIMIT = 4096
#: Pre-tokens of one generation that a Python worker remembers; there are two generations.
REMEMBERED = 200_000
#: Sequences of more symbols keep their pairs' positions by rank.
LONG = 2_000
#: Symbols merged at a time; bounds the arrays.
AT_ONCE = 2_000_000
SPACE = "▁"
#: No piece has a space mark after another character, and none a line feed, so no merge crosses these borders.
PRETOKEN = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n+")
_NONE = np.iinfo(np.int64).max
_MIX = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def vocabulary_path(name: str) -> str:
    """A path as it is, or the installed file of a public vocabulary's name; resolved where it is used, on the executor."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def pretokens(text: str | None) -> list[str]:
    """Pre-tokens of a text with the model's space marks and its leading mark; none for an empty or null text."""
    return PRETOKEN.findall(SPACE + text.replace(" ", SPACE)) if text else []


class Memory:
    """What is known of pre-tokens. When the young generation is full it becomes the old one; what is met again comes back from there, the rest goes with it."""

    def __init__(self, most: int = REMEMBERED) -> None:
        self.most, self.young, self.old = most, {}, {}

    def unknown(self, words: set[str]) -> list[str]:
        """Of these words, those to be learned; the others are in the young generation afterwards."""
        missing = words.difference(self.young)
        if len(self.young) + len(missing) > self.most:
            self.old, self.young, missing = self.young, {}, words
        again = missing.intersection(self.old)
        self.young.update(zip(again, map(self.old.__getitem__, again)))
        return list(missing.difference(again))


class PairTable:
    """Known pairs (first * n + second) and what they become: a hash table in arrays, with a second one for slots that are taken."""

    def __init__(self, keys: np.ndarray, made: np.ndarray) -> None:
        self.keys, self.made = np.r_[keys, np.int64(-1)], np.r_[made, np.int64(0)]
        self.shift = 64 - max(4, int(len(keys) * 8).bit_length())
        self.levels: list[np.ndarray] = []
        left = np.arange(len(keys))
        while len(left):
            table = np.full(1 << (64 - self.shift), -1, np.int32)
            slot = self._slot(self.keys[left], len(self.levels))
            table[slot] = left
            self.levels.append(table)
            left = left[table[slot] != left]

    def _slot(self, keys: np.ndarray, level: int) -> np.ndarray:
        mix = np.uint64((_MIX[level % 2] + 2 * (level // 2) * _MIX[0]) % (1 << 64) | 1)
        return ((keys.view(np.uint64) * mix) >> np.uint64(self.shift)).view(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Index of each key, or -1."""
        found = self.levels[0][self._slot(keys, 0)]
        wrong = np.flatnonzero(self.keys[found] != keys)
        found[wrong[found[wrong] < 0]] = -1
        wrong = wrong[found[wrong] >= 0]
        for level in range(1, len(self.levels)):
            if not len(wrong):
                break
            again = self.levels[level][self._slot(keys[wrong], level)]
            found[wrong] = again
            wrong = wrong[(again >= 0) & (self.keys[again] != keys[wrong])]
        found[wrong] = -1
        return found


class Merger:
    def __init__(self, name: str = VOCABULARY) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=vocabulary_path(name))
        self.size = n = sp.get_piece_size()
        scores = np.array([sp.get_score(i) for i in range(n)])
        self.ids = {sp.id_to_piece(i): i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))}
        rank = np.unique(-scores, return_inverse=True)[1].astype(np.int64)
        crossing = [p for p in self.ids if re.search(f"[^{SPACE}]{SPACE}", p) or "\n" in p]
        if crossing:
            raise ValueError(f"pieces cross the borders of pre-tokens: {crossing[:3]}")
        pairs: dict[tuple[int, int], int] = {}
        alone = np.zeros(n, bool)  # merging all of a sequence's pairs of such a piece at once might pass over a lower rank
        for p, i in self.ids.items():
            for k in range(1, len(p)):
                a, b = self.ids.get(p[:k]), self.ids.get(p[k:])
                if a is not None and b is not None:
                    pairs[a, b] = i
                for x in (a, b):
                    if x is not None and rank[i] <= rank[x]:
                        alone[x] = True
        self.table = PairTable(np.array([a * n + b for a, b in pairs], np.int64), np.array(list(pairs.values()), np.int64))
        self.become = dict(zip(self.table.keys.tolist(), self.table.made.tolist()))
        self.rank, self.alone, self.ranks = rank, alone, rank.tolist()
        #: Symbol of each code point; one outside the vocabulary is size + its number of UTF-8 bytes.
        self.point = np.repeat(np.arange(n + 1, n + 5, dtype=np.int32), [0x80, 0x780, 0xF800, 0x100000])
        for p, i in self.ids.items():
            if len(p) == 1:
                self.point[ord(p)] = i

    def symbols(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of the single characters of all words, and how many each word has."""
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        return self.point[points].astype(np.int64), np.fromiter(map(len, words), np.int64, len(words))

    def pairs(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the known pairs of two arrays of symbols, and the piece each becomes."""
        found = self.table.find(np.where((a < self.size) & (b < self.size), a * self.size + b, -2))
        at = np.flatnonzero(found >= 0)
        return at, self.table.made[found[at]]

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Surviving symbols of all words, one after another, and how many each word has."""
        parts, sizes, at = [], [], 0
        while at < len(words):
            if len(words[at]) > LONG:
                stop = at + 1
                parts.append(self.by_rank(self.symbols(words[at:stop])[0]))
                sizes.append(np.array([len(parts[-1])], np.int64))
            else:
                stop, total = at, 0
                while stop < len(words) and len(words[stop]) <= LONG and total < AT_ONCE:
                    total += len(words[stop])
                    stop += 1
                sym, n = self.rounds(*self.symbols(words[at:stop]))
                parts.append(sym)
                sizes.append(n)
            at = stop
        return (np.concatenate(parts), np.concatenate(sizes)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def rounds(self, sym: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(sizes)
        seq = np.repeat(np.arange(n), sizes)
        out_sym, out_seq = [sym[:0]], [seq[:0]]
        while len(sym):
            at, made = self.pairs(sym[:-1], sym[1:])
            same = seq[at] == seq[at + 1]
            at, made = at[same], made[same]
            busy = np.zeros(n, bool)
            busy[seq[at]] = True
            active = busy[seq]
            if not active.all():
                out_sym.append(sym[~active])
                out_seq.append(seq[~active])
            if not len(at):
                break
            ranks, owner = self.rank[made], seq[at]
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            best = np.repeat(np.minimum.reduceat(ranks, first), np.diff(np.r_[first, len(owner)]))
            chosen = ranks == best
            at, made, owner = at[chosen], made[chosen], owner[chosen]
            use = self.apart(at, owner, made, at[1:] == at[:-1] + 1)
            sym[at[use]] = made[use]
            active[at[use] + 1] = False
            sym, seq = sym[active], seq[active]
        sym, seq = np.concatenate(out_sym), np.concatenate(out_seq)
        return sym[np.argsort(seq, kind="stable")], np.bincount(seq, minlength=n)

    def apart(self, at: np.ndarray, owner: np.ndarray, made: np.ndarray, touches: np.ndarray) -> np.ndarray:
        """Which of the chosen pairs are merged: every other one of a run that touches, or a sequence's first alone where the rest might have to wait."""
        start = np.r_[True, owner[1:] != owner[:-1]]
        run = start | np.r_[True, ~touches]
        count = np.arange(len(at))
        place = count - np.maximum.accumulate(np.where(run, count, 0))
        lead = np.flatnonzero(start)
        single = np.repeat(self.alone[made[lead]], np.diff(np.r_[lead, len(at)]))
        return np.where(single, start, place % 2 == 0)

    def by_rank(self, sym: np.ndarray) -> np.ndarray:
        """The same rounds for one long sequence: a round has the positions that wait under the lowest rank, and merged symbols are passed over by links."""
        out = [*sym.tolist(), self.size]  # the end is a symbol without pairs
        n = len(sym)
        after, before = list(range(1, n + 2)), list(range(-1, n))
        piece = [-1] * (n + 1)
        waiting: dict[int, list[int]] = {}
        order: list[int] = []

        def offer(p: int, made: int) -> None:
            piece[p] = made
            if made >= 0:
                r = self.ranks[made]
                if r not in waiting:
                    waiting[r] = []
                    heapq.heappush(order, r)
                waiting[r].append(p)

        at, made = self.pairs(sym[:-1], sym[1:])
        for p, m in zip(at.tolist(), made.tolist()):
            offer(p, m)
        while order:
            r = heapq.heappop(order)
            some = sorted(set(waiting.pop(r)))
            for k, p in enumerate(some):
                made = piece[p]
                if made < 0 or self.ranks[made] != r:
                    continue  # it was merged otherwise since, or by the one before it in this round
                gone = after[p]
                out[p], out[gone], piece[gone] = made, -1, -1
                after[p] = after[gone]
                before[after[p]] = p
                for q in (before[p], p):
                    if q >= 0:
                        a, b = out[q], out[after[q]]
                        offer(q, self.become.get(a * self.size + b, -1) if a < self.size and b < self.size else -1)
                if self.alone[made] and order and order[0] <= r:  # the rest has to wait for what this merge has brought
                    if r not in waiting:
                        waiting[r] = []
                        heapq.heappush(order, r)
                    waiting[r] += some[k + 1 :]
                    break
        return np.array([x for x in out[:n] if x >= 0], np.int64)

    def weights(self, sym: np.ndarray) -> np.ndarray:
        return np.where(sym < self.size, 1, sym - self.size)


@lru_cache(2)
def merger(name: str = VOCABULARY) -> Merger:
    return Merger(name)


_KEPT: dict = {}


def kept(*key: object, make: Callable[[], object]) -> object:
    """What a Python worker remembers from task to task: one thing at a time, so stages that follow one another in a worker don't add up."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]


def counter(name: str) -> Callable[[list], list]:
    def work(texts: list) -> list:
        own, memory = merger(name), kept("counts", name, make=Memory)
        split = [pretokens(t) for t in texts]
        new = memory.unknown(set().union(*split))
        sym, sizes = own.merge(new)
        ends = np.cumsum(np.r_[0, own.weights(sym)])[np.cumsum(np.r_[0, sizes])]
        seen = memory.young
        seen.update(zip(new, np.diff(ends).tolist()))
        return [(len(encoded(t)), sum(map(seen.__getitem__, words))) for t, words in zip(texts, split)]

    return work


def count_tokens(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, limit: int = OVER_LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row.

    A null or empty text has no bytes and no tokens. Null ids and repeated rows give a row each; an empty table gives an
    empty one; other columns are not read. Ties of rank go to the leftmost pair. Texts of any length are counted whole.
    """
    out = text_map(pick(docs, doc_id=doc_id, text=text), lambda: counter(vocabulary), "n_bytes long, n_tokens long")
    return out.withColumn("over_limit", out.n_tokens > limit)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(read(spark, sf_dir, "documents"))
