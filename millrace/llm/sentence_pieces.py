"""SentencePiece encoding and decoding by an Aho-Corasick Viterbi.

One automaton holds all pieces. Each pre-token is read once; at each position the automaton follows its output links to all
pieces that end there, and each relaxes the best score of its end from that of its start. The public vocabulary is one of
merges, whose stored scores are only their order; a piece's log probability is therefore taken by Zipf's law from its place
in that order. A character that no piece covers costs the least score less UNKNOWN_COST and becomes its UTF-8 bytes. Of
paths of equal score, the piece that starts first (the longest) wins.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame, SparkSession

from millrace.llm.common import encoded, pick, read, text_map
from millrace.llm.token_count import SPACE, VOCABULARY, Memory, kept, pretokens, vocabulary_path

#: As the library's unigram models have it.
UNKNOWN_COST = 10.0


class PieceCodec:
    def __init__(self, name: str = VOCABULARY) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=vocabulary_path(name))
        self.automaton, self.bytes_at = ahocorasick.Automaton(), {}
        self.raw: list[bytes] = []
        n = sp.get_piece_size()
        pieces = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
        place = np.unique([-sp.get_score(i) for i in pieces], return_inverse=True)[1] + 1.0
        log_p = -np.log(place) - np.log((1 / place).sum())
        #: Score of each id as it stands in a text's path: pieces their own, the first byte of an uncovered character its cost, further bytes nothing.
        self.score_of = np.zeros(n)
        self.score_of[pieces] = log_p
        self.unknown = float(log_p.min()) - UNKNOWN_COST
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                value = int(piece[1:-1], 16)
                self.bytes_at[value] = i
                self.score_of[i] = 0.0 if value & 0xC0 == 0x80 else self.unknown
                self.raw.append(bytes([value]))
            elif sp.is_control(i) or sp.is_unknown(i):
                self.raw.append(b"")
            else:
                self.automaton.add_word(piece, (i, len(piece), float(self.score_of[i])))
                self.raw.append(piece.replace(SPACE, " ").encode())
        self.automaton.make_automaton()
        self.is_byte = np.zeros(n, bool)
        self.is_byte[list(self.bytes_at.values())] = True
        self.memory = Memory()

    def viterbi(self, word: str) -> list[int]:
        """Ids of the best path."""
        n = len(word)
        best, via = [0.0] + [-np.inf] * n, [(-1, 1)] * (n + 1)
        at = 0  # ends up to here are final but for unknown characters
        for end, (i, size, score) in self.automaton.iter(word):
            while at < end:
                at += 1
                if best[at] == -np.inf:
                    best[at] = best[at - 1] + self.unknown
            start = end + 1 - size
            if best[start] + score > best[end + 1]:
                best[end + 1], via[end + 1] = best[start] + score, (i, size)
        ids, at = [], n
        while at:
            i, size = via[at]
            if i < 0:
                ids += [self.bytes_at[b] for b in reversed(word[at - 1].encode("utf-8", "surrogatepass"))]
            else:
                ids.append(i)
            at -= size
        return ids[::-1]

    def encode_all(self, texts: list) -> list[tuple[np.ndarray, float, int]]:
        """Ids, score and how many ids are bytes, of each text. No piece crosses the borders of pre-tokens, so their best paths make up the text's."""
        split = [pretokens(t) for t in texts]
        new, seen = self.memory.unknown(set().union(*split)), self.memory.young
        for word in new:
            seen[word] = np.array(self.viterbi(word), np.int32).tobytes()
        out = []
        for words in split:
            ids = np.frombuffer(b"".join(map(self.memory.young.__getitem__, words)), np.int32)
            out.append((ids, float(self.score_of[ids].sum()), int(np.count_nonzero(self.is_byte[ids]))))
        return out

    def encode(self, text: str | None) -> tuple[list[int], float, int]:
        ((ids, score, in_bytes),) = self.encode_all([text])
        return ids.tolist(), score, in_bytes

    def decode(self, ids: list[int]) -> str:
        """The text of ids: spaces for marks, bytes put together, without the leading mark's space."""
        raw = b"".join(map(self.raw.__getitem__, ids))
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "surrogatepass")


def codec(name: str = VOCABULARY) -> PieceCodec:
    return kept("pieces", name, make=lambda: PieceCodec(name))


def encode_pieces(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), vocabulary: str = VOCABULARY) -> DataFrame:
    """The columns `keep`, then ids array<int>, n_pieces, n_byte_pieces and score for every row; no shuffle.

    A null or empty text has no ids and scores 0. Null ids and repeated rows give a row each; an empty table an empty one;
    other columns are not read. Texts are encoded whole; equal scores go to the longest last piece.
    """

    def make() -> Callable[[list], list]:
        own = codec(vocabulary)

        def work(texts: list) -> list:
            return [(ids, len(ids), in_bytes, score) for ids, score, in_bytes in own.encode_all(texts)]

        return work

    df = pick(docs, **{k: k for k in keep}, **({} if text in keep else {text: text}))
    return text_map(df, make, "ids array<int>, n_pieces long, n_byte_pieces long, score double", keep=keep, text=text)


def decode_pieces(df: DataFrame, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",), vocabulary: str = VOCABULARY) -> DataFrame:
    """The columns `keep` and the text of each row's ids; null ids give an empty text. U+2581 in a text comes back as a space, as with the library."""

    def make() -> Callable[[list], list]:
        own = codec(vocabulary)
        return lambda rows: [(own.decode(r or []),) for r in rows]

    return text_map(pick(df, **{k: k for k in keep}, **{ids: ids}), make, "text string", keep=keep, text=ids)


def digest_pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """encode_pieces with a digest in place of the ids (SHA-256 of little-endian 32-bit ids), and whether decoding gives the text back.

    A null or empty text has no pieces, scores 0 and comes back. Null ids and repeated rows give a row each; an empty table
    an empty one; other columns are not read. Texts are encoded whole.
    """

    def make() -> Callable[[list], list]:
        own = codec(vocabulary)

        def work(texts: list) -> list:
            rows = []
            for t, (ids, score, in_bytes) in zip(texts, own.encode_all(texts)):
                sha = hashlib.sha256(ids.astype("<i4").tobytes()).hexdigest()
                rows.append((len(encoded(t)), len(ids), in_bytes, score, sha, own.decode(ids.tolist()) == (t or "").replace(SPACE, " ")))
            return rows

        return work

    return text_map(pick(docs, doc_id=doc_id, text=text), make, "n_bytes long, n_pieces long, n_byte_pieces long, score double, ids_sha256 string, round_trip boolean")


def op6_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_pieces(read(spark, sf_dir, "documents"))
