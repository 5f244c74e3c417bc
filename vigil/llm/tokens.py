"""Token counts by a count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton lists the vocabulary's pieces in a text by their last character; the
dynamic program keeps, for each position, the best score and the number of pieces of the path
that has it.  Ties follow the unigram tokenizer of the ``tokenizers`` library: of paths of
equal score to a position the one with the longer last piece stays.  A character without a
piece of its own costs ten less than the worst piece and counts as its UTF-8 bytes (byte
pieces), or, without byte pieces, a run of them as one.

Blanks become U+2581 and one is put before the text.  No piece spans a border between another
character and a blank (checked when the vocabulary is read), so that words are solved one by
one and remembered.  The vocabulary file is a parameter; its pieces and scores are read as a
unigram vocabulary, never trained.
"""

from __future__ import annotations

import os
import re

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import prepare, table, text_or_empty

TOKENIZERS = "/opt/tokenizers"
MODEL = "piece_bpe_32k.model"
REMEMBERED = 400_000
BLANK = "▁"


def vocabulary(path: str) -> list[tuple[str, float]]:
    """(piece, score) of a sentencepiece file, in the order of the ids; id 0 is the unknown piece."""
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


class Counter:
    """Counts pieces; picklable as its vocabulary, the automaton is built where it is used."""

    def __init__(self, pieces: list[tuple[str, float]], unknown: int = 0):
        self.pieces, self.unknown = pieces, unknown
        if any(BLANK in p.lstrip(BLANK) for p, _ in pieces):
            raise ValueError("a piece spans the border between a character and a blank")
        self.breaks = not any("\n" in p for p, _ in pieces)
        self.bytes = all(f"<0x{b:02X}>" in {p for p, _ in pieces} for b in range(256))
        self.penalty = min(s for _, s in pieces) - 10.0
        self.automaton = None

    def __getstate__(self):
        return self.__dict__ | {"automaton": None, "memory": None, "single": None}

    def _start(self):
        self.automaton = ahocorasick.Automaton()
        for piece, score in self.pieces:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.single = {p for p, _ in self.pieces if len(p) == 1}
        self.memory: dict[str, int] = {}

    def word(self, word: str) -> int:
        """Pieces of the best path over ``word``."""
        n = len(word)
        best, count, unknown = [0.0] + [None] * n, [0] * (n + 1), [False] * (n + 1)
        done = 0

        def close(upto: int) -> None:  # a character without own piece, after the longer pieces that end there
            nonlocal done
            while done < upto:
                i, c = done, word[done]
                if c not in self.single:
                    s = best[i] + self.penalty
                    if best[i + 1] is None or s > best[i + 1]:
                        best[i + 1], unknown[i + 1] = s, True
                        if self.bytes:
                            count[i + 1] = count[i] + len(c.encode("utf-8", "replace"))
                        else:
                            count[i + 1] = count[i] + (not unknown[i])
                done += 1
        for last, (length, score) in self.automaton.iter(word):
            close(last)
            i = last + 1 - length
            s = best[i] + score
            if best[last + 1] is None or s > best[last + 1]:
                best[last + 1], count[last + 1], unknown[last + 1] = s, count[i] + 1, False
        close(n)
        return count[n]

    def text(self, text: str) -> int:
        if not text:
            return 0
        if self.automaton is None:
            self._start()
        pattern = _WORDS_AND_LINES if self.breaks and self.bytes else _WORDS
        total, memory = 0, self.memory
        for m in pattern.finditer(" " + text.replace(BLANK, " ")):
            w = m.group()
            k = memory.get(w)
            if k is None:
                if len(memory) >= REMEMBERED:
                    memory.clear()
                k = self.word(w.replace(" ", BLANK))
                if len(w) <= 64:
                    memory[w] = k
            total += k
        return total


_WORDS_AND_LINES = re.compile(r" *[^ \n]+|\n| +")
_WORDS = re.compile(r" *[^ ]+| +")


def count_tokens(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens) of every document; null and empty texts have none.  Repeated rows and
    a null doc_id are kept; an empty table gives no rows; other columns are ignored."""
    prepare(docs.sparkSession)
    counter = Counter(vocabulary(path or os.path.join(TOKENIZERS, MODEL)))

    def run(batches):
        for batch in batches:
            n = np.fromiter((counter.text(t) for t in batch.column(1).to_pylist()), np.int64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n)], names=["doc_id", "n_tokens"])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(
        run, "doc_id long, n_tokens long")


def op5_tokens(spark, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
