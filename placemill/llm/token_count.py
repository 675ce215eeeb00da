"""Token counts with the whole-token shortcut, for a sentencepiece BPE vocabulary.

A pre-token is a run of spaces (each escaped as U+2581, one put before the text) with what follows up to the next space.  No
piece of a vocabulary that passes `provable` has the escape after another character, so no merge crosses from one pre-token to the
next: a text's count is the sum of its pre-tokens' counts.  `whole_tokens` proves once which vocabulary strings encode alone as
one token; pre-tokens among them count 1, and the rest is merged by the library, each distinct one once per cache.

Null texts count as empty ones: no bytes, no tokens.  The count has no limit of length; rows repeat and ids may be null.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placemill.llm.common import mapped, table

MARK = "▁"
#: A pre-token that is one escape and nothing else, under a name that no pre-token has once the escapes in a text are spaces.
ALONE = MARK
#: Pre-tokens whose counts a worker remembers; beyond that it forgets those that were merged and starts again.
REMEMBERED = 400_000
#: Characters up to which a merged pre-token is remembered.
SHORT = 32


def vocabulary_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def provable(pieces: list[str]) -> bool:
    """Whether no piece goes on across the start of a pre-token."""
    return all(MARK not in p.lstrip(MARK) for p in pieces)


class Counter:
    """Counts of whole texts; `split` tells whether the shortcut holds for this vocabulary (else the library counts whole texts)."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.split = provable(pieces) and self._keeps_spaces()
        self.whole = self.whole_tokens(pieces) if self.split else {}
        if self.split:
            self.whole[ALONE] = len(self.model.encode("a ")) - len(self.model.encode("a"))
        self.known = dict(self.whole)

    def _keeps_spaces(self) -> bool:
        """Whether the model, as far as these probes show, changes nothing but putting one space before a text."""
        probes = ["a  b ", " a", "ﬁ Ａ", "Á\t\n x", " a　b"]
        return all(self.model.decode(self.model.encode(p)) == p for p in probes) and self.model.encode("a b", out_type=str)[0].startswith(MARK)

    def whole_tokens(self, pieces: list[str]) -> dict[str, int]:
        """Words that encode alone as one token, without their escape."""
        words = [p[1:] for p in pieces if p.startswith(MARK) and len(p) > 1 and MARK not in p[1:]]
        return {w: 1 for w, ids in zip(words, self.model.encode(words, num_threads=1), strict=True) if len(ids) == 1}

    def count(self, text: str) -> int:
        if not text:
            return 0
        if not self.split:
            return len(self.model.encode(text, num_threads=1))
        words = text.replace(MARK, " ").split(" ")  # the library can't tell the escape from a space either
        if "" in words:  # spaces in a row, at the start or at the end
            words = self._with_spaces(words)
        known, once = self.known, 0
        if new := set(words).difference(known):
            if len(known) + len(new) > REMEMBERED and len(known) > len(self.whole):
                self.known = known = dict(self.whole)
                new = set(words).difference(known)
            listed = list(new)
            counts = dict(zip(listed, map(len, self.model.encode(listed, num_threads=1)), strict=True))
            if len(new) > REMEMBERED:
                return sum(known.get(w) or counts[w] for w in words)
            for w in listed:  # those too long to remember are counted here
                if len(w) > SHORT:
                    once += counts.pop(w) * words.count(w)
            known.update(counts)
        return once + sum(map(known.get, words, repeat(0)))

    @staticmethod
    def _with_spaces(words: list[str]) -> list[str]:
        """Pre-tokens without their first space: spaces in a row go before the word that follows, or stand alone at the end."""
        out, spaces = [], 0
        for w in words:
            if w:
                out.append(" " * spaces + w)
                spaces = 0
            else:
                spaces += 1
        if spaces:  # an escape each; the model puts the first one before what it encodes, unless that is empty
            out.append(" " * (spaces - 1) if spaces > 1 else ALONE)
        return out


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def token_counts(docs: DataFrame, limit: int = 4096, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit), a row for each input row."""
    path = path or vocabulary_path()

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for batch in batches:
            n = [c.count(t) if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    return mapped(rows, counts, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


SQL = None
