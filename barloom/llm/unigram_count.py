"""Token counts by count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton names every vocabulary piece that ends at each character; dynamic programming carries the best
score and its piece count and no path. Ties are the tokenizer's: of equal scores for one end, the piece that starts
first stays. A character without a piece of its own scores ten below the worst piece and counts its UTF-8 bytes.
Where scores are whole numbers, sums are exact; if then no piece has a space after other characters, each run between
spaces is counted for itself and remembered. Otherwise a text is counted in one go, adding in the tokenizer's order.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
UNKNOWN_BELOW = 10.0
REMEMBERED = 400_000
_RUN = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")


def load_pieces(path: str = VOCABULARY) -> list[tuple[str, float]]:
    """Ordinary pieces and scores of a sentencepiece file; control, unknown and byte pieces match no text."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(m.id_to_piece(i), m.get_score(i)) for i in range(m.get_piece_size()) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))]


class Counting:
    """Counts tokens of texts by a list of pieces and scores."""

    def __init__(self, pieces: list[tuple[str, float]]):
        self.machine = ahocorasick.Automaton()
        for p, s in pieces:
            self.machine.add_word(p, (len(p), s))
        self.machine.add_word("\0" * 64, (64, -math.inf))  # an automaton needs a word
        self.machine.make_automaton()
        self.unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN_BELOW
        self.apart = not any(re.search(f"[^{SPACE}]{SPACE}", p) or s != int(s) for p, s in pieces)
        self.single = frozenset(p for p, _ in pieces if len(p) == 1)
        self.known: dict[str, tuple[int, float]] = {}

    def best(self, run: str) -> tuple[int, float]:
        """Pieces of the best segmentation and its score."""
        n = len(run)
        if self.single.issuperset(run):
            top, many = [0.0] + [-math.inf] * n, [0] * (n + 1)
            for last, (size, s) in self.machine.iter(run):  # at one end the longest, which starts first, comes first
                s += top[last + 1 - size]
                if s > top[last + 1]:
                    top[last + 1], many[last + 1] = s, many[last + 1 - size] + 1
            return many[n], top[n]
        score, count = [0.0] + [None] * n, [0] * (n + 1)
        at = 0

        def close(end: int, single: bool):
            # the unknown character ends here and starts last, so it comes after all pieces
            if not single:
                s = score[end - 1] + self.unknown
                if score[end] is None or s > score[end]:
                    score[end], count[end] = s, count[end - 1] + len(run[end - 1].encode("utf-8", "surrogatepass"))

        single = False
        for last, (size, s) in self.machine.iter(run):
            end = last + 1
            while at < end - 1:
                at += 1
                close(at, single)
                single = False
            single |= size == 1
            s += score[end - size]
            if score[end] is None or s > score[end]:
                score[end], count[end] = s, count[end - size] + 1
        while at < n:
            at += 1
            close(at, single)
            single = False
        return count[n], score[n]

    def count(self, text: str | None) -> tuple[int, float]:
        """Pieces and score of a text, a space put before it; null and empty texts have none."""
        if not text:
            return 0, 0.0
        spaced = SPACE + text.replace(" ", SPACE)
        if not self.apart:
            return self.best(spaced)
        if len(self.known) > REMEMBERED:
            self.known.clear()
        n, total = 0, 0.0
        for run, many in Counter(_RUN.findall(spaced)).items():
            got = self.known.get(run)
            if got is None:
                got = self.best(run)
                if len(run) < 64:
                    self.known[run] = got
            n += got[0] * many
            total += got[1] * many
        return n, total


_made: dict[int, Counting] = {}


def count_tokens(docs: DataFrame, pieces: list[tuple[str, float]]) -> DataFrame:
    """``doc_id, n_tokens, score`` of every row's whole text; rows stay apart, other columns are left out.

    Null and empty texts have no tokens and score 0; a null doc_id stays null; an empty table gives no rows.
    The vocabulary goes to the executors with the task: its size is that of a tokenizer's file, whatever the corpus.
    """
    key = hash(tuple(pieces))

    def run(batches):
        if key not in _made:
            _made[key] = Counting(pieces)
        c = _made[key]
        for b in batches:
            got = [c.count(t.as_py()) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([x[0] for x in got], pa.int64()), pa.array([x[1] for x in got], pa.float64())], ["doc_id", "n_tokens", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, score double")
