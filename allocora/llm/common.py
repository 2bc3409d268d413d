"""Helpers the operators share: words, cached token ids, row counts."""

from __future__ import annotations

import functools
import os
import re
from array import array
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from allocora.runtime import scratch_path

#: Words are runs of characters other than these six ASCII blanks.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
WORD_SQL = r"[^\x20\x09-\x0D]+"
#: Lower-cases A-Z and nothing else.
ASCII_LOWER = {upper: upper + 32 for upper in range(65, 91)}

_BLANK = r"\t\n\x0b\x0c\r "
_WITH_BLANKS = re.compile(f"[{_BLANK}]*[^{_BLANK}]+|[{_BLANK}]+")
_WITHOUT_BLANKS = re.compile(f"[^{_BLANK}]+")
_BLANKS_TOGETHER = re.compile(r"\s[ \n]|\n\s")
_SEPARATORS = re.compile("[\x1c-\x1f]")
#: What ``\s`` finds besides spaces and line ends.
_RARE_BLANKS = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]
#: Characters beyond ASCII that pre-tokenizers may count as blank; texts that need it are encoded whole.
_OTHER_BLANKS = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: A word and signs after it, of which no pre-tokenizer makes one piece. The apostrophe is left out: it starts pieces like 't.
_WORD_AND_SIGNS = re.compile(r"([A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+)([!-&(-/:-@\[-`{-~]*)")

CACHE_PIECES = 600_000
CACHE_PIECE_CHARS = 40


def ascii_lower(text: str) -> str:
    """``text`` with A-Z lower-cased; other letters stay."""
    return text.lower() if text.isascii() else text.translate(ASCII_LOWER)


def _blanks_together(text: str) -> bool:
    """Whether ``_BLANKS_TOGETHER`` is found; where spaces and line ends are the only blanks, without a search by character."""
    if any(map(text.__contains__, _RARE_BLANKS)):
        return _BLANKS_TOGETHER.search(text) is not None
    return any(map(text.__contains__, ("  ", " \n", "\n ", "\n\n")))


class _Pieces(dict):
    """Bytes of pieces, found when first asked for; long pieces are not kept."""

    def __init__(self, find: Callable[[str], bytes]):
        self.find = find

    def __missing__(self, piece: str) -> bytes:
        found = self.find(piece)
        if len(piece) <= CACHE_PIECE_CHARS:
            self[piece] = found
        return found


def _byte_letters() -> list[str]:
    """The character that byte-level vocabularies write for each byte: itself if it can be seen, else one from 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in seen]
    return [chr(b) if b in seen else chr(256 + hidden.index(b)) for b in range(256)]


class WordEncoder:
    """Token ids of whole texts, from ids of their pieces.

    A text is cut where a space follows something that is not blank, and round line
    ends without blanks beside them, which is where the vocabularies' own
    pre-tokenizers cut too, so that pieces can be encoded one by one. The tokenizers
    library encodes them; what it gives is kept for at most ``CACHE_PIECES`` short
    pieces per worker, because words repeat; a word with signs after it shares the
    entry of the word alone. ``keep_blanks`` says whether blanks belong to tokens
    (byte-level vocabularies) or separate them (vocabularies with word ends, in
    lower case).
    """

    def __init__(self, path: str, keep_blanks: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        self.keep_blanks = keep_blanks
        self.letters = _byte_letters()
        self.signs = _Pieces(self._word)
        self.plain = _Pieces(self._plain)
        self.spaced = _Pieces(self._after_blank)

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _word(self, word: str) -> bytes:
        """A piece of letters or signs that the pre-tokenizer leaves whole, straight through the library's model."""
        if word.isascii():  # each byte but the space is its own letter
            letters = word.replace(" ", self.letters[32])
        else:
            letters = "".join([self.letters[b] for b in word.encode()])
        return array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()

    def _after_blank(self, piece: str) -> bytes:
        """A piece after a space, or one that begins with its line end."""
        if piece.isalpha() and piece.isascii():
            return self._word(" " + piece)
        if piece[:1] == "\n":
            return self.plain["\n"] + self.plain[piece[1:]]
        return self._plain(" " + piece)

    def _plain(self, piece: str) -> bytes:
        """A word alone goes to the model; one with signs after it is that word's entry and the signs'."""
        spaced = piece[:1] == " "
        found = _WORD_AND_SIGNS.fullmatch(piece, spaced)
        if found is None:
            return self._whole(piece)
        if not found[2]:
            return self._word(piece)
        return (self.spaced if spaced else self.plain)[found[1]] + self.signs[found[2]]

    def _encode(self, text: str) -> bytes:
        if not self.keep_blanks:
            if _SEPARATORS.search(text):
                return b"".join(map(self._whole, _WITHOUT_BLANKS.findall(text)))
            try:
                text.encode("latin-1")
                text = text.lower()
                return b"".join(map(self.plain.__getitem__, text.split()))
            except UnicodeEncodeError:  # letters whose lower case depends on what is round them
                return b"".join(map(self._whole, text.split()))
        if not _blanks_together(text):
            first, *others = text.replace("\n", " \n").split(" ")
            return self.plain[first] + b"".join(map(self.spaced.__getitem__, others))
        if _OTHER_BLANKS.search(text):
            return self._whole(text)
        return b"".join(map(self.plain.__getitem__, _WITH_BLANKS.findall(text)))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; a null text has none."""
        for cache in (self.signs, self.plain, self.spaced):
            if len(cache) > CACHE_PIECES:
                cache.clear()
        return [self._encode(text) if text else b"" for text in texts]


@functools.lru_cache(maxsize=4)
def word_encoder(path: str, keep_blanks: bool) -> WordEncoder:
    """One encoder for all tasks of a Python worker."""
    return WordEncoder(path, keep_blanks)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table in the shared folder, so that nothing before it runs again."""
    path = scratch_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def least_hashed(df: DataFrame, want: int, total: int, *columns: str) -> DataFrame:
    """About ``want`` of ``total`` rows at most: those with the least hashes of ``columns``, ties by the columns.

    Rows far above the cut are dropped where they are read, so that tasks do not
    each hand on ``want`` rows. Small tables are taken whole.
    """
    share = min(1.0, (2 * want + 100) / max(total, 1))
    cut = int(-(2.0**63) + share * 2.0**64)
    hashed = F.xxhash64(*columns)
    near = df if share >= 1 else df.filter(hashed < F.lit(cut))
    return near.orderBy(hashed, *columns).limit(want)


def fold(doc_id: str | Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as empty text."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(column.cast("string"), F.lit(""))) % modulus
