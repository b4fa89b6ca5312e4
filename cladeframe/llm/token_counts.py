"""Token counts (1) of a unigram model by dynamic programming over a shared trie.

A pre-token is a stretch between ASCII white space, led by the vocabulary's word mark. The distinct
new pre-tokens of a batch are sorted, which visits their trie depth first: the stack holds the
forward scores of the current path, so the scores of a prefix are computed once for all words below
it, and the count at a terminal node is stored for its word. A text's count is the sum of its
words' counts.

The model: pieces of a public vocabulary. Such a file ranks its pieces but states no
probabilities; piece number r has probability proportional to 1 / (r + 1) (Zipf's law). The best
segmentation has the highest sum of logarithms, then the fewest pieces. A character that is no piece
is one piece per UTF-8 byte, at the score of the least piece.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

VOCABULARY = "piece_bpe_32k.model"
MARK = "▁"


def vocabulary(path: str | None = None) -> dict[str, float]:
    """piece: log probability."""
    import public_tokenizers
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path or public_tokenizers.path(VOCABULARY))
    pieces = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    total = math.log(sum(1 / (r + 1) for r in range(len(pieces))))
    return {model.id_to_piece(i): -math.log(r + 1) - total for r, i in enumerate(pieces)}


def trie_counts(words: list[str], score: dict[str, float], longest: int) -> list[int]:
    """Pieces in the best segmentation of each word; words must be sorted."""
    worst = min(score.values(), default=-1.0)
    get = score.get
    out, last, best, count = [], "", [0.0], [0]
    for w in words:
        n, same = len(w), 0
        for x, y in zip(last, w):
            if x != y:
                break
            same += 1
        del best[same + 1 :], count[same + 1 :]
        for end in range(same + 1, n + 1):
            top, pieces = -math.inf, 0
            for start in range(max(0, end - longest), end):
                s = get(w[start:end])
                if s is not None:
                    s += best[start]
                    if s > top or s == top and count[start] + 1 < pieces:
                        top, pieces = s, count[start] + 1
            if get(w[end - 1]) is None:
                k = len(w[end - 1].encode("utf-8", "surrogatepass"))
                if (s := best[end - 1] + k * worst) > top:
                    top, pieces = s, count[end - 1] + k
            best.append(top)
            count.append(pieces)
        last = w
        out.append(count[n])
    return out


class Counts(common.Memo):
    """word (bytes): its number of tokens."""

    def __init__(self, score: dict[str, float]):
        super().__init__()
        self.score, self.longest = score, max(map(len, score), default=1)

    def learn(self, words: set[bytes]) -> None:
        self.held += sum(map(len, words)) + self.ENTRY * len(words)
        new = sorted((MARK + w.decode("utf-8", "replace"), w) for w in words if w not in self)
        self.update(zip((w for _, w in new), trie_counts([s for s, _ in new], self.score, self.longest)))


_COUNTS: dict[str, Counts] = {}
_BYTES_AT_ONCE = 4_000_000


def _counts(name: str, score: dict[str, float]) -> Counts:
    """The worker's own memo of a vocabulary."""
    if name not in _COUNTS:
        _COUNTS[name] = Counts(score)
    return _COUNTS[name].begin()


def count_texts(texts: list[bytes], counts: Counts):
    """(words, tokens) of each text, in order."""
    split = [text.split() for text in texts]
    if counts.full():
        counts.clear()
    known = [list(map(counts.get, words)) for words in split]
    new = {w for words, k in zip(split, known) if None in k for w, c in zip(words, k) if c is None}
    if new:
        counts.learn(new)
    for words, k in zip(split, known):
        yield len(words), sum(map(counts.__getitem__, words) if None in k else k)


def token_counts(documents: DataFrame, path: str | None = None) -> DataFrame:
    """documents: doc_id, text. Returns doc_id, n_words, n_tokens, one row per row; null and empty texts
    have 0 of both; no rows, no result."""
    spark = documents.sparkSession
    common.ship(spark)
    score = spark.sparkContext.broadcast(vocabulary(path))  # a vocabulary: some ten thousand pieces

    name = path or VOCABULARY

    def run(batches):
        counts = _counts(name, score.value)
        for batch, texts in common.slices(batches, 1, _BYTES_AT_ONCE):
            both = list(count_texts(texts, counts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([w for w, _ in both], pa.int64()), pa.array([t for _, t in both], pa.int64())], ["doc_id", "n_words", "n_tokens"])

    return common.pick(documents, "doc_id", "text").mapInArrow(run, "doc_id long, n_words long, n_tokens long")
