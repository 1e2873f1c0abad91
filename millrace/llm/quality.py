"""Quality rules from public tokenisers' fertility.

Public vocabularies are asked how they cut a text: characters a token by two of them (pieces with a fall back to bytes, and
byte pairs), the share of tokens that are bytes of characters the first lacks, and the entropy of its tokens. Each language
(else each script) has bands for the four; a text outside a band is rejected, and so is one that fails the plain rules on
words and repeated windows.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import ROWS_AT_ONCE, encoded, pick, read, text_map
from millrace.llm.token_count import SPACE, VOCABULARY, Memory, kept, merger, pretokens, vocabulary_path

#: The second vocabulary: byte pairs as ranks.
BYTE_VOCABULARY = "byte_bpe_50k.tiktoken"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 20
WINDOW = 8
MAX_REPEAT_PERCENT = 30
#: Bands by language, else by script, as (least, most) characters a token, most byte share, least entropy in bits, and
#: (least, most) characters a token of the second vocabulary. Measured: in ordinary sentences, letters drawn at random in their place,
#: and invented words that keep a language's syllables. English has 4.7 to 5.3, 1.7 to 1.9 and 2.2 to 2.8 characters a token; German,
#: French and Spanish 3.2 to 3.5, 1.6 to 2.0 and 2.0 to 2.7; Russian 2.3 to 2.5 and 1.2 to 1.4. Scripts whose letters are tokens of their own
#: are told by the second vocabulary (Greek 0.88 to 0.91 and 0.78 to 0.83), Hangul, Han and Thai by the share of characters that fall back to bytes.
BANDS = {
    "en": (2.02, 12.0, 0.10, 4.0, 1.98, 12.0),
    "de": (2.02, 12.0, 0.10, 4.0, 1.98, 12.0),
    "fr": (2.00, 12.0, 0.10, 4.0, 1.96, 12.0),
    "es": (1.98, 12.0, 0.10, 4.0, 1.94, 12.0),
    "latin": (1.98, 12.0, 0.15, 3.5, 1.94, 12.0),
    "latin_marked": (1.35, 12.0, 0.15, 3.5, 0.95, 12.0),
    "cyrillic": (1.65, 8.00, 0.20, 3.5, 0.82, 8.00),
    "greek": (0.95, 8.00, 0.20, 3.0, 0.86, 8.00),
    "arabic": (1.06, 8.00, 0.20, 3.0, 0.85, 8.00),
    "arabic_wide": (0.93, 8.00, 0.20, 3.0, 0.72, 8.00),
    "devanagari": (0.88, 8.00, 0.15, 3.0, 0.61, 8.00),
    "thai": (0.90, 8.00, 0.06, 3.0, 0.40, 8.00),
    "hangul": (0.65, 8.00, 0.50, 3.0, 0.44, 8.00),
    "han": (0.70, 8.00, 0.45, 3.0, 0.45, 8.00),
    "other": (0.25, 8.00, 0.95, 3.0, 0.20, 8.00),
}
#: Ranges of code points of each script's letters.
SCRIPTS = {
    "latin": ((0x41, 0x5B), (0x61, 0x7B), (0xC0, 0x250), (0x1E00, 0x1F00)),
    "cyrillic": ((0x400, 0x530),),
    "greek": ((0x370, 0x400), (0x1F00, 0x2000)),
    "arabic": ((0x600, 0x700), (0x750, 0x780)),
    "devanagari": ((0x900, 0x980),),
    "thai": ((0xE00, 0xE80),),
    "hangul": ((0xAC00, 0xD7A4),),
    "han": ((0x3040, 0x3100), (0x3400, 0xA000)),
}
#: Languages with letters beyond a script's first ones have fewer characters a token; a text with this share of such letters has their band: script, first letters, band.
WIDE = {"latin": ((0x41, 0x7B), 0.03, "latin_marked"), "arabic": ((0x621, 0x660), 0.02, "arabic_wide")}
#: Texts of few tokens vary more: for n tokens the bands are wider by the factor 1 + WIDER / sqrt(n), and no more entropy is asked than this share of the most that n tokens can have.
WIDER, ENTROPY_SHARE = 0.5, 0.45
_SPACES = " \t\n\v\f\r"


def script(text: str) -> str:
    """The band for a text whose language has none: the script of most of its letters, other if most are of none of these."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    points = points[points >= 0x41]
    counts = {name: sum(int(np.count_nonzero((points >= a) & (points < b))) for a, b in ranges) for name, ranges in SCRIPTS.items()}
    most = max(counts, key=counts.get)
    others = int(np.count_nonzero(points >= 0x530)) - sum(counts[s] for s in counts if s not in ("latin", "cyrillic", "greek"))
    if counts[most] < others:
        return "other"
    if most in WIDE:
        (a, b), share, wide = WIDE[most]
        if counts[most] - int(np.count_nonzero((points >= a) & (points < b))) > share * counts[most]:
            return wide
    return most


def repeated_words(ids: np.ndarray, window: int = WINDOW) -> int:
    """Words, as numbers, that lie in a window found twice or more. Ids of windows of 1, 2, 4, ... words are made from ids of halves, so equal ids mean equal words; where all shorter windows differ, all of them do."""
    total, n = len(ids), len(ids) - window + 1
    if n < 2:
        return 0
    width = 1
    while width < window:
        step = min(width, window - width)
        left, right = ids[:-step], ids[step:]
        known, ids = np.unique(left * (int(ids.max()) + 1) + right, return_inverse=True)
        if len(known) == len(ids):
            return 0
        width += step
    twice = np.flatnonzero(np.bincount(ids)[ids] > 1)
    ends = np.zeros(total + 1, np.int64)
    np.add.at(ends, twice, 1)
    np.add.at(ends, twice + window, -1)
    return int(np.count_nonzero(np.cumsum(ends)[:-1]))


def duplicate_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if x.strip(_SPACES)]
    return len(lines) - len(set(lines))


def in_band(band: tuple[float, ...], n: int, fert: float, share: float, entropy: float, byte_fert: float) -> bool:
    low, high, most_bytes, least_bits, byte_low, byte_high = band
    if not n:
        return False
    wide = 1 + WIDER / math.sqrt(n)
    least_bits = min(least_bits, ENTROPY_SHARE * math.log2(n))
    return low / wide <= fert <= high * wide and byte_low / wide <= byte_fert <= byte_high * wide and share <= most_bytes * wide and entropy >= least_bits


class Fertility:
    """Tokens of pre-tokens, remembered as 32-bit numbers in bytes, so a text's are put together by one join.

    After a pre-token's symbols (up to size + 4, see Merger) stands the number of its tokens in the second vocabulary, raised by size + 5.
    """

    def __init__(self, vocabulary: str, byte_vocabulary: str) -> None:
        import public_tokenizers
        import tiktoken

        self.merger, self.memory = merger(vocabulary), Memory()
        with open(vocabulary_path(byte_vocabulary), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.byte_pairs = tiktoken.Encoding("byte_pairs", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def learn(self, split: list[list[str]]) -> None:
        new = self.memory.unknown(set().union(*split))
        sym, sizes = self.merger.merge(new)
        ends = np.cumsum(sizes + 1)
        flat = np.empty(len(sym) + len(new), np.int32)
        last = np.zeros(len(flat), bool)
        last[ends - 1] = True
        flat[~last], flat[last] = sym, self.merger.size + 5 + np.array(list(map(self.byte_tokens, new)), np.int64)
        raw, ends = flat.tobytes(), (4 * ends).tolist()
        self.memory.young.update(zip(new, map(raw.__getitem__, map(slice, [0, *ends], ends))))

    def byte_tokens(self, word: str) -> int:
        """Lone surrogates are question marks to the second vocabulary."""
        word = word.replace(SPACE, " ")
        return len(self.byte_pairs.encode_ordinary(word if word.isascii() else word.encode("utf-8", "replace").decode()))

    def measure(self, words: list[str], chars: int) -> tuple[int, float, float, float, float]:
        """Tokens, characters a token, byte share, entropy in bits, and characters a token of the second vocabulary; characters outside the vocabulary count in the entropy by their number of bytes."""
        if not words:
            return 0, 0.0, 0.0, 0.0, 0.0
        size = self.merger.size
        counts = np.bincount(np.frombuffer(b"".join(map(self.memory.young.__getitem__, words)), np.int32), minlength=size + 5)
        in_second = counts[size + 5 :]
        byte_tokens = int((in_second * np.arange(len(in_second))).sum())
        in_bytes = int((counts[size : size + 5] * np.arange(5)).sum())
        counts = counts[: size + 5]
        total = int(counts.sum())
        n = total - int(counts[size:].sum()) + in_bytes
        counts = counts[counts > 0]
        entropy = float(np.log2(total) - (counts * np.log2(counts)).sum() / total)
        return n, chars / n, in_bytes / n, entropy, chars / max(byte_tokens, 1)


def fertility_of(vocabulary: str, byte_vocabulary: str = BYTE_VOCABULARY) -> Fertility:
    return kept("fertility", vocabulary, byte_vocabulary, make=lambda: Fertility(vocabulary, byte_vocabulary))


def judge(vocabulary: str, bands: dict) -> Callable[[list, list], list]:
    def work(texts: list, langs: list) -> list:
        fertility = fertility_of(vocabulary)
        texts = [t or "" for t in texts]
        split = [pretokens(t) for t in texts]
        fertility.learn(split)
        rows, all_words = [], [encoded(t).split() for t in texts]
        codes = {w: k for k, w in enumerate(set().union(*all_words))}
        for text, lang, pieces, words in zip(texts, langs, split, all_words):
            n_words, repeat = len(words), repeated_words(np.array(list(map(codes.__getitem__, words)), np.int64))
            chars = len(text) - sum(map(text.count, _SPACES))
            failed = n_words < MIN_WORDS or 100 * repeat > MAX_REPEAT_PERCENT * n_words
            n, fert, share, entropy, byte_fert = fertility.measure(pieces, len(text))
            # Digits are a token each, in any language: the first vocabulary's band is for the rest.
            digits = sum(map(text.count, "0123456789"))
            fits = in_band(bands.get(lang) or bands[script(text)], n, (len(text) - digits) / max(n - digits, 1), share, entropy, byte_fert)
            rows.append((n_words, chars, sum(map(text.count, SYMBOLS)), duplicate_lines(text), repeat, failed, fits and not failed, n, fert, share, entropy, byte_fert))
        return rows

    return work


COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_tokens long, chars_per_token double, byte_share double, token_entropy double, chars_per_byte_token double"


def quality_rules(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", vocabulary: str = VOCABULARY, bands: dict | None = None) -> DataFrame:
    """One row with counts, measures and the verdict `kept` for every row of docs; no shuffle.

    A null or empty text has no words, fails the plain rules and is not kept. A null language, or one without bands, takes
    the bands of the text's script. Null ids and repeated rows give a row each; an empty table an empty one; other columns
    are not read. Texts are measured whole.
    """
    bands = bands or BANDS

    def make() -> Callable[[list], list]:
        work = judge(vocabulary, bands)
        return lambda pairs: work([p["t"] for p in pairs], [p["l"] for p in pairs])

    df = pick(docs, doc_id=doc_id, t=text, l=lang).select("doc_id", F.struct("t", "l").alias("text"))
    return text_map(df, make, COLUMNS)


def keep_good(docs: DataFrame, text: str = "text", lang: str = "lang", vocabulary: str = VOCABULARY, bands: dict | None = None) -> DataFrame:
    """The rows of docs that quality_rules keeps, with all their columns as they are; cases as there."""
    bands = bands or BANDS
    t, l = docs.columns.index(text), docs.columns.index(lang)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = judge(vocabulary, bands)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                yield part.filter(pa.array([r[6] for r in work(part.column(t).to_pylist(), part.column(l).to_pylist())], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(read(spark, sf_dir, "documents"))
