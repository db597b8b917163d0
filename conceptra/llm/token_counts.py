"""Token counts under a unigram vocabulary, by dynamic programming shared along a trie.

A pre-token is a run of characters other than space and \\x09-\\x0D with the word mark put before it.
Its segmentation is the one with the largest sum of piece scores (then the fewest pieces); a
character that no piece covers falls back to one token for each of its UTF-8 bytes. Distinct
pre-tokens are visited as a trie in depth-first order: the forward scores of a prefix are computed
once and stand for all pre-tokens below it, and each terminal stores its number of tokens.

The pieces' scores follow from their ranks in the vocabulary file by Zipf's law: the file holds ranks and
no probabilities, and tokenizers are not trained here.

Null and empty texts have 0 tokens. Repeated rows are counted each. Only doc_id and text are read. A
pre-token, however long, is one path of the trie, whose scores are the only thing kept of it. No rows
in: no rows out.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, documents, slices, small_batches, tidy

MARK = "▁"
#: Score of a token that stands for a byte.
BYTE_SCORE = -20.0
#: Terminals that a worker remembers between batches before it starts afresh.
REMEMBERED = 400_000


def load_pieces(path: str) -> dict[str, float]:
    """Pieces of a vocabulary file with scores by rank, as Zipf's law has them; control and byte pieces are left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return {model.id_to_piece(i): -math.log(i + 2) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}


class TrieCounter:
    def __init__(self, pieces: dict[str, float]):
        self.pieces, self.longest = pieces, max(map(len, pieces), default=1)
        self.terminals: dict[bytes, int] = {}

    def add(self, words) -> None:
        """Stores the terminal counts of words (bytes) that are not known yet."""
        pieces, longest = self.pieces, self.longest
        before, best, tokens = "", [0.0], [0]
        for word in sorted(words):
            text = MARK + word.decode("utf-8", "replace")
            shared, most = 0, min(len(text), len(before))
            while shared < most and text[shared] == before[shared]:
                shared += 1
            del best[shared + 1 :], tokens[shared + 1 :]
            for end in range(shared + 1, len(text) + 1):
                size = len(text[end - 1].encode("utf-8", "replace"))
                top, n = best[end - 1] + BYTE_SCORE * size, tokens[end - 1] + size
                for start in range(max(0, end - longest), end):
                    score = pieces.get(text[start:end])
                    if score is not None:
                        score += best[start]
                        if score > top or score == top and tokens[start] + 1 < n:
                            top, n = score, tokens[start] + 1
                best.append(top)
                tokens.append(n)
            before = text
            self.terminals[word] = tokens[-1]

    def count(self, texts: list[bytes]) -> list[tuple[int, int]]:
        """(words, tokens) of every text."""
        split = [t.split() for t in texts]
        if len(self.terminals) > REMEMBERED:
            self.terminals.clear()
        known = self.terminals
        self.add({w for words in split for w in words if w not in known})
        return [(len(words), sum(map(known.__getitem__, words))) for words in split]


_counters: dict[str, TrieCounter] = {}


def counter_of(path: str) -> TrieCounter:
    """One counter for a worker process; what it remembers serves all tasks."""
    if path not in _counters:
        _counters[path] = TrieCounter(load_pieces(path))
    return _counters[path]


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_words, n_tokens of every row."""

    def run(batches):
        counter = counter_of(path)
        for batch in batches:
            out = []
            for _, texts in slices(batch, CHUNK_BYTES):
                out += counter.count(texts)
            counts = [pa.array([o[k] for o in out], pa.int64()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *counts], ["doc_id", "n_words", "n_tokens"])

    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(tidy(run), "doc_id long, n_words long, n_tokens long")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))
