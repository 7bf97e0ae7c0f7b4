"""Token counts by the whole-token shortcut.

Which vocabulary strings encode alone as one token is proved offline, by the library
itself, when a worker loads the file.  A pre-token that is such a string counts as one
without any merging; only the rest goes through the merges.  A text's chunks between
white space are independent (no pre-token and no normalisation step crosses it),
so whole chunks are looked up first: their counts sum in one pass.

Defined results: a null text is the empty text, with no bytes and no tokens; the
strings of special tokens inside a text count as the library's default has it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Generations, arrow_batches

#: Entries of one generation of the cache of chunks (some 200 bytes each).
CHUNKS = 250_000
#: White space for str.split() but not for the tokenizers' patterns; all other kinds agree.
ODD_SPACE = ("\x1c", "\x1d", "\x1e", "\x1f")
ASCII_SPACE = re.compile("[ \t\n\r\x0b\x0c]+")


def chunks_of(text: str) -> list[str]:
    """The runs between white space; no pre-token and no normalisation step crosses it."""
    return [chunk for chunk in ASCII_SPACE.split(text) if chunk] if any(c in text for c in ODD_SPACE) else text.split()


def byte_letters() -> dict[int, str]:
    """byte -> the letter that stands for it in byte-level vocabularies: itself if printable, else the next free one from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return {byte: chr(byte if byte in printable else next(free)) for byte in range(256)}


class WordBpe:
    """A word-end BPE file: chunks to pre-tokens by our own rules where those are proved equal, else the library for the whole chunk."""

    #: Characters whose normalisation is plain lower-casing: printable ASCII and precomposed Latin letters (but U+0130).
    PLAIN = re.compile("[!-~À-ÖØ-öø-įı-ɏ]+")
    #: The file's split pattern over those characters.
    PRE_TOKEN = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zÀ-ÖØ-öø-ɏ]+|[0-9]|[^a-z0-9À-ÖØ-öø-ɏ]+")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.specials = tuple(t.content for t in self.library.get_added_tokens_decoder().values())
        self._letters = byte_letters()
        self._merge = self.library.model.tokenize

    def pre_tokens(self, chunk: str) -> list[str] | None:
        """The normalised pre-tokens of ``chunk``, or None where only the library will do."""
        if chunk.isascii() and chunk.isalpha():
            return [chunk.lower()]
        if not self.PLAIN.fullmatch(chunk) or ("<" in chunk and any(s in chunk for s in self.specials)):
            return None
        low = chunk.lower()
        return [low] if low.isalpha() else self.PRE_TOKEN.findall(low)

    def merge(self, piece: str) -> list[int]:
        """The ids of one normalised pre-token."""
        mapped = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self._letters)
        return [token.id for token in self._merge(mapped)]


class WordCounter:
    """Counts for a tokenizers file."""

    def __init__(self, path: str):
        self.bpe = WordBpe(path)
        self.shortcut = self._whole_tokens()
        self._chunks = Generations(self._count, CHUNKS)

    def _whole_tokens(self) -> frozenset[str]:
        """The vocabulary's words that the library encodes alone as one token, each a single pre-token."""
        library = self.bpe.library
        words = [w for w in (v.removesuffix("</w>") for v in library.get_vocab() if v.endswith("</w>")) if self.bpe.pre_tokens(w) == [w]]
        found: list[str] = []
        for at in range(0, len(words), 4096):
            part = words[at : at + 4096]
            found += [w for w, e in zip(part, library.encode_batch_fast(part, add_special_tokens=False)) if len(e.ids) == 1]
        return frozenset(found)

    def _count(self, chunk: str) -> int:
        if chunk in self.shortcut:
            return 1
        pieces = self.bpe.pre_tokens(chunk)
        if pieces is None:
            return len(self.bpe.library.encode(chunk, add_special_tokens=False).ids)
        if pieces == [chunk]:
            return len(self.bpe.merge(chunk))
        return sum(map(self._chunks.__getitem__, pieces))  # a pre-token is a chunk of itself

    def count(self, text: str) -> int:
        return sum(map(self._chunks.__getitem__, chunks_of(text)))


class PieceCounter:
    """Counts for a sentencepiece file: the shortcut needs words apart, which such files don't promise, so every text is merged."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)

    def count(self, text: str) -> int:
        return len(self.library.encode(text, num_threads=1)) if text else 0


_LOADED: dict[str, object] = {}


def counter(path: str):
    if path not in _LOADED:
        _LOADED[path] = PieceCounter(path) if path.endswith(".model") else WordCounter(path)
    return _LOADED[path]


def count_tokens(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each row of ``docs``; one pass without a shuffle."""
    arrow_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = counter(path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            counts = [tool.count(t) for t in texts]
            sizes = [len(t) if t.isascii() else len(t.encode()) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array([c > limit for c in counts], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
