"""Token counts under a unigram model, by a trie that shares forward scores.

Texts split at ASCII white space into pre-tokens; each gets the word mark in front. Distinct
pre-tokens go into a trie whose nodes keep the best forward score of their prefix and the number
of pieces on that best way, so a prefix that many pre-tokens share is scored once; the node where
a pre-token ends gives its count. The pieces come from a public vocabulary, with its unigram scores.
Where that file holds merge ranks instead, a piece of rank r has the Zipf log-probability
-log(r + 2.7); nothing is trained here. A character that no piece covers counts one token for each
UTF-8 byte. A pre-token too long to share a prefix with others is scored outside the trie, by the
same steps, keeping only as many scores as the longest piece reaches back.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import documents, pick, text_pieces

MARK = "▁"
#: Longest pre-token, in characters, that goes into the trie.
LONG = 1_000
BYTE_SCORE = -25.0


def load_pieces(path: str | None = None) -> dict[str, float]:
    """Piece -> log-probability, of a vocabulary file's ordinary pieces in the order of their ids."""
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path("piece_bpe_32k.model"))
    ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    scores = [model.get_score(i) for i in ids]
    if all(s == int(s) for s in scores):  # merge ranks
        scores = [-math.log(r + 2.7) for r in range(len(ids))]
    return {model.id_to_piece(i): s for i, s in zip(ids, scores, strict=True)}


class PieceTrie:
    """Distinct pre-tokens with the forward scores of all their prefixes; forgets all beyond `most` nodes."""

    def __init__(self, scores: dict[str, float], most: int = 600_000):
        self.scores, self.longest, self.most = scores, max(map(len, scores), default=1), most
        ends: dict[str, int] = {}
        for p in scores:  # the longest piece that ends in a character, to stop the inner loop early
            ends[p[-1]] = max(ends.get(p[-1], 0), len(p))
        self.ends = ends
        self.reset()

    def reset(self) -> None:
        self.child: dict[tuple[int, str], int] = {}
        self.score, self.pieces = [0.0], [0]
        self.terminal: dict[bytes, int] = {}

    def insert(self, word: str) -> int:
        """The number of pieces of the best segmentation; ties go to the longer last piece."""
        child, score, pieces, scores = self.child, self.score, self.pieces, self.scores
        node, path = 0, [0]
        for i, ch in enumerate(word, 1):
            at = child.get((node, ch))
            if at is None:
                best, count = score[node] + BYTE_SCORE * (n := len(ch.encode("utf-8", "replace"))), pieces[node] + n
                for size in range(1, min(i, self.ends.get(ch, 0)) + 1):
                    s = scores.get(word[i - size : i])
                    if s is not None:
                        before = path[i - size]
                        if score[before] + s >= best:
                            best, count = score[before] + s, pieces[before] + 1
                at = child[node, ch] = len(score)
                score.append(best)
                pieces.append(count)
            node = at
            path.append(node)
        return pieces[node]

    def outside(self, word: str) -> int:
        """insert() without the trie."""
        scores, last = self.scores, [(0.0, 0)]
        for i, ch in enumerate(word, 1):
            n = len(ch.encode("utf-8", "replace"))
            best, count = last[-1][0] + BYTE_SCORE * n, last[-1][1] + n
            for size in range(1, min(i, self.ends.get(ch, 0)) + 1):
                s = scores.get(word[i - size : i])
                if s is not None and last[-size][0] + s >= best:
                    best, count = last[-size][0] + s, last[-size][1] + 1
            last = [*last[1 - self.longest :], (best, count)] if self.longest > 1 else [(best, count)]
        return last[-1][1]

    def count(self, word: bytes) -> int:
        n = self.terminal.get(word)
        if n is not None:
            return n
        text = MARK + word.decode("utf-8", "replace")
        if len(text) > LONG:
            return self.outside(text)
        if len(self.score) > self.most:
            self.reset()
        n = self.terminal[word] = self.insert(text)
        return n


def _count(path: str | None):
    def run(batches):
        trie = PieceTrie(load_pieces(path))
        for batch in batches:
            tokens, words, chars = [], [], []
            for t in (t for _, some in text_pieces(batch.column(1)) for t in some):
                ws = t.split()
                got = list(map(trie.terminal.get, ws))
                if None in got:
                    got = [trie.count(w) if n is None else n for w, n in zip(ws, got, strict=True)]
                tokens.append(sum(got))
                words.append(len(ws))
                chars.append(len(t) - int(np.count_nonzero((np.frombuffer(t, np.uint8) & 0xC0) == 0x80)))
            yield pa.record_batch([batch.column(0).cast(pa.int64()), pa.array(chars, pa.int64()), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], names=["doc_id", "n_chars", "n_pretokens", "n_tokens"])

    return run


def token_counts(docs: DataFrame, *, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, n_chars, n_pretokens, n_tokens) for each row of docs (doc_id, text, ...).

    A null or blank text has no tokens; repeated rows give repeated rows; an empty table none;
    other columns are ignored. No shuffle; memory: a batch of texts and a trie of bounded size.
    """
    return pick(docs, "doc_id", "text").mapInArrow(_count(vocabulary), "doc_id bigint, n_chars bigint, n_pretokens bigint, n_tokens bigint")


def op4_token_counts(spark, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir))
