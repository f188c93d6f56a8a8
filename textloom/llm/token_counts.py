"""Token counts under a unigram model, with the dynamic program shared between pre-tokens.

The pieces are those of a public vocabulary. The model gives the piece of rank r (its place in the
vocabulary, from 1) a probability proportional to 1 / r; a character that is no piece costs one
byte piece for each of its UTF-8 bytes. A pre-token is U+2581 and a run of characters without
white space; its token count is that of its most probable segmentation, and among equals that
with the fewest tokens.

Distinct pre-tokens go into a trie. The best score of a prefix depends only on the prefix, so
each trie node works it out once for all pre-tokens below it; ends of pre-tokens keep the counts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START = "▁"
#: Trie nodes that a worker holds; when full it starts anew, which costs time but changes nothing.
MOST_NODES = 300_000


#: Marks an ending of a piece that isn't a piece itself.
NO_PIECE = 1.0


@lru_cache(2)
def vocabulary(path: str) -> tuple[dict[str, float], float]:
    """Log10 probabilities of the pieces and of a byte piece; endings of pieces map to NO_PIECE."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    norm = math.log10(sum(1 / r for r in range(1, n + 1)))
    plain = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    scores = {model.id_to_piece(i): -math.log10(i + 1) - norm for i in plain}
    endings = {piece[k:]: NO_PIECE for piece in scores for k in range(1, len(piece))}
    return endings | scores, -math.log10(n) - norm


class Trie:
    """Pre-tokens with shared prefixes. ``ends`` maps each to its token count and score."""

    def __init__(self, scores: dict[str, float], byte_score: float):
        self.scores, self.byte_score = scores, byte_score
        self.clear()

    def clear(self) -> None:
        self.child: dict[tuple[int, str], int] = {}
        self.best, self.tokens = [0.0], [0]
        self.ends: dict[str, tuple[int, float]] = {}

    def insert(self, word: str) -> tuple[int, float]:
        """Adds a word, if it is new, and returns its token count and score."""
        if (found := self.ends.get(word)) is not None:
            return found
        if len(self.best) > MOST_NODES:
            self.clear()
        child, best, tokens, scores = self.child, self.best, self.tokens, self.scores
        token, node, path = START + word, 0, [0]
        for i, c in enumerate(token, 1):
            below = child.get((node, c))
            if below is None:
                if scores.get(c, NO_PIECE) <= 0:
                    top, count = -math.inf, 0
                else:
                    size = len(c.encode())
                    top, count = best[node] + size * self.byte_score, tokens[node] + size
                for k in range(i - 1, -1, -1):
                    score = scores.get(token[k:i])
                    if score is None:
                        break  # no piece ends like this, so none ends in anything longer
                    if score <= 0:
                        total, n = best[path[k]] + score, tokens[path[k]] + 1
                        if total > top or total == top and n < count:
                            top, count = total, n
                below = child[node, c] = len(best)
                best.append(top)
                tokens.append(count)
            node = below
            path.append(node)
        found = self.ends[word] = tokens[node], best[node]
        return found


def unigram_counts(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_pretokens, n_tokens and log10_prob (of the best segmentation) of each row.

    Each task keeps its own trie, so nothing is shuffled and memory is bounded. Null texts count
    as empty (zeros), repeated rows and null ids stay, an empty table gives no rows, a very long
    run without white space costs time in proportion to its length; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(*vocabulary(path))
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                words = (text or "").split()
                ends = trie.ends
                counts, total = 0, 0.0
                for word in words:
                    found = ends.get(word)
                    if found is None:
                        found = trie.insert(word)
                        ends = trie.ends
                    counts += found[0]
                    total += found[1]
                rows.append((len(words), counts, total))
            n, tokens, scores = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(tokens, pa.int64()), pa.array(scores, pa.float64())],
                names=["doc_id", "n_pretokens", "n_tokens", "log10_prob"],
            )

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_pretokens long, n_tokens long, log10_prob double")
