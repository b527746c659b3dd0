"""Operator 6, token counts by dynamic programming shared over a trie.

A white-space-free chunk gives one or two pre-tokens: its body with the word mark before it, and the
run of ASCII punctuation that ends it (a chunk of punctuation alone is a body). Each distinct
pre-token is inserted in a trie whose nodes hold the forward score of their prefix (its best
segmentation into pieces, and how many pieces that has): a prefix that many pre-tokens share is
scored once, and the node where a pre-token ends stores its count, so a later occurrence costs a
look-up.

The pieces come from a public vocabulary. Their scores are an approximation, -ln(rank + 2): the
vocabulary has ranks and no probabilities, and tokenizers are not trained here. Ties in score go to
fewer pieces. A character that begins no piece's path counts as the bytes of its UTF-8 form, each at
the score of an unseen byte.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import bounded, chunks_of, one_byte_spaces, plain, set_apart
from .memory import Memory
from .runtime import ship

MARK = "▁"
TAIL = ".,;:!?#$%&*|()[]{}<>\"+=-_/~"
IN_TAIL = np.isin(np.arange(256), list(TAIL.encode()))
APART = "\x01"  # stands before a tail that is set apart
KEPT = 1_000_000
NODES = 500_000
UNSEEN = 2.0  # a byte scores this much below the rarest piece
_vocab: dict = {}
_sizes: dict[str, Lengths] = {}
_chunks: dict[str, Memory] = {}
_tries: dict[str, Trie] = {}


class Lengths(dict):
    """The lengths, from 1 on, that a piece may have which ends in two given characters."""

    def __missing__(self, pair):
        return (1,)


def unigram(path: str) -> tuple[dict[str, float], int, float]:
    """(score by piece, longest piece, score of an unseen byte)."""
    if path not in _vocab:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        scores = {p: -math.log(i + 2) for i, p in enumerate(names)}
        _vocab[path] = scores, max(map(len, scores)), -math.log(len(scores) + 2) - UNSEEN
        found: dict[str, set[int]] = {}
        for p in scores:
            if len(p) > 1:
                found.setdefault(p[-2:], set()).add(len(p))
        _sizes[path] = Lengths({pair: (1, *sorted(n)) for pair, n in found.items()})
    return _vocab[path]


class Trie:
    """Prefixes of pre-tokens with their forward scores. It starts anew beyond `limit` nodes, so a worker's memory is bounded."""

    def __init__(self, path: str, limit: int = NODES):
        self.scores, _, self.byte = unigram(path)
        self.limit = limit
        self.sizes = _sizes[path]
        self.clear()

    def clear(self) -> None:
        self.child: dict[int, int] = {}  # node << 21 | character -> node
        self.best, self.used = [0.0], [0]

    def count(self, words: list[str]) -> dict[str, tuple[float, float]]:
        """(pieces, score) of the best segmentation of each word; new prefixes are scored on the way."""
        out, get = {}, self.scores.get
        for word in words:
            if len(self.best) > self.limit:
                self.clear()
            child, best, used = self.child, self.best, self.used
            node, path = 0, [0]
            for end, c in enumerate(word, 1):
                key = node << 21 | ord(c)
                node = child.get(key, -1)
                if node < 0:
                    node = child[key] = len(best)
                    width = 1 if c < "\x80" else len(c.encode("utf-8", "surrogatepass"))
                    b, u = best[path[-1]] + width * self.byte, used[path[-1]] + width
                    for size in self.sizes[word[end - 2 : end]] if end > 1 else (1,):
                        at = end - size
                        if at < 0:
                            break
                        s = get(word[at:end])
                        if s is not None:
                            s += best[path[at]]
                            if s > b or (s == b and used[path[at]] + 1 < u):
                                b, u = s, used[path[at]] + 1
                    best.append(b)
                    used.append(u)
                path.append(node)
            out[word] = used[node], best[node]
        return out


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_tokens, log_score) of every whole text, in one pass without a shuffle.

    Null and empty texts have 0, 0 and 0.0. Repeated ids give a row each, a null id stays null;
    further columns are ignored, whatever their names; an empty table gives no rows.
    """

    def run(it):
        trie = _tries.setdefault(path, Trie(path))
        chunks = _chunks.setdefault(path, Memory(KEPT, np.float64))

        def count(some: list[str]) -> list[bytes]:
            # A chunk that begins with APART and goes on with punctuation is the tail of one.
            words = [c[1:] if len(c) > 1 and c[0] == APART and not c[1:].strip(TAIL) else MARK + c for c in some]
            known = trie.count(sorted(set(words)))
            return [np.array([1, *known[w]]).tobytes() if c else b"" for c, w in zip(some, words)]

        for batch in bounded(it, 1):
            # The chunks of a batch are numbered, and only distinct ones become Python strings.
            lists = chunks_of(set_apart(one_byte_spaces(plain(batch.column(1))), IN_TAIL, b" " + APART.encode()))
            coded = lists.flatten().dictionary_encode()
            at = chunks.places(coded.dictionary, count)[coded.indices.to_numpy(zero_copy_only=False)]
            # Each chunk has a word, its pieces and its score; the empty ones at the ends of a text have none.
            table = np.zeros((len(at), 3))
            full = chunks.sizes[at] > 0
            table[full] = chunks.flat.reshape(-1, 3)[chunks.starts[at[full]] // 3]
            sums = np.zeros((len(batch), 3))
            bounds = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            some = np.flatnonzero(np.diff(bounds))
            if len(some):
                sums[some] = np.add.reduceat(table, bounds[some])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(sums[:, k].astype(np.int64)) for k in (0, 1)), pa.array(sums[:, 2])], ["doc_id", "n_words", "n_tokens", "log_score"])

    ship(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_words long, n_tokens long, log_score double")
