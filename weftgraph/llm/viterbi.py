"""Token counts by a count-only Viterbi search over a unigram vocabulary.

An Aho-Corasick automaton reports every vocabulary piece that ends at each position of a word; the
search carries, for each position, the best score and the number of pieces on its path, and no
back pointers. Ties follow the exact rule of the Unigram tokenizer: of pieces that end at one
place, the longest comes first and a later one must score strictly more; a character that is no
piece itself may stand as unknown, at the least score less 10, and comes last. Unknown characters
count one for each byte where the vocabulary has byte pieces; else a run of them counts once.

Words are ``[^\\x20\\x09-\\x0D]+``, each behind the word mark; pieces do not cross words, so a
text's count is the sum over its words, and words are remembered (``memory`` of them at most in a
worker; the rest is computed again). Null and empty texts have no tokens; words of any length are
searched whole, in linear memory; repeated rows are counted each; empty tables give empty results;
other columns do not matter.

The vocabulary is a public one, named by its path; nothing is trained. Control, unknown and byte
pieces (``</s>``, ``<0x41>``) stand for no text and are not looked for. The file holds the pieces
of a merge-based tokenizer in order of rank, without probabilities, so that a piece's score is set
by rule, -log(rank + 2), as for words under Zipf's law.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from math import inf, log

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm.common import arrow_map, table, utf8

MARK = "▁"
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"


@dataclass(frozen=True)
class Vocabulary:
    """Pieces of text with their scores, in the order of ids; the score of an unknown character,
    and whether it falls back to bytes."""

    pieces: tuple[tuple[str, float], ...]
    unknown: float
    by_byte: bool = False


def vocabulary(path: str = VOCABULARY) -> Vocabulary:
    """Read on the driver."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    text = [i for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    return Vocabulary(tuple((model.id_to_piece(i), -log(i + 2)) for i in text), -log(len(ids) + 1) - 10.0, sum(map(model.is_byte, ids)) == 256)


class Counter(dict):
    """Number of tokens of a word (bytes), computed at the first call for it."""

    def __init__(self, known: Vocabulary, memory: int = 400_000):
        self.memory = memory
        self.machine = ahocorasick.Automaton()
        for piece, score in known.pieces:
            self.machine.add_word(piece, (len(piece), score))
        self.machine.make_automaton()
        self.unknown, self.bytes = known.unknown, known.by_byte

    def __missing__(self, word: bytes) -> int:
        n = self.count(MARK + word.decode("utf-8", "replace"))
        if len(word) <= 64:
            if len(self) >= self.memory:
                self.clear()
            self[word] = n
        return n

    def count(self, text: str) -> int:
        n = len(text)
        best, pieces, loose = [0.0] + [-inf] * n, [0] * (n + 1), [False] * (n + 1)
        unknown, by_byte = self.unknown, self.bytes
        done = 0  # ends up to here are settled

        def settle(upto: int) -> None:
            """Ends that no piece reaches are unknown characters."""
            nonlocal done
            for e in range(done + 1, upto + 1):
                stray(e)
            done = upto

        def stray(e: int) -> None:
            score = best[e - 1] + unknown
            if score > best[e]:
                best[e] = score
                extra = len(text[e - 1].encode("utf-8", "replace")) if by_byte else 0 if loose[e - 1] else 1
                pieces[e], loose[e] = pieces[e - 1] + extra, True

        single = True
        at = 0
        for last, (length, score) in self.machine.iter(text):
            e = last + 1
            if e != at:
                if not single:
                    stray(at)
                if at:
                    done = at
                settle(e - 1)
                at, single = e, False
            total = best[e - length] + score
            if total > best[e]:
                best[e], pieces[e], loose[e] = total, pieces[e - length] + 1, False
            if length == 1:
                single = True
        if at:
            if not single:
                stray(at)
            done = at
        settle(n)
        return pieces[n]


_counters: dict[int, Counter] = {}


def token_counts(docs: DataFrame, known: Vocabulary, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_words, n_tokens)``."""
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def kernel(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
        which = hash(shared.value)  # a worker keeps its words between tasks
        if which not in _counters:
            _counters.clear()
            _counters[which] = Counter(shared.value)
        of = _counters[which]
        for batch in batches:
            words, tokens = [], []
            for t in batch.column(1):
                w = t.as_py().split()
                words.append(len(w))
                tokens.append(sum([of[x] for x in w]))
            yield {"doc_id": batch.column(0), "n_words": words, "n_tokens": tokens}

    return arrow_map(docs.select(F.col(key).cast("long").alias("doc_id"), utf8(text).alias("text")), kernel, "doc_id long, n_words long, n_tokens long")


def op9_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), vocabulary())
