"""Token counts of texts, without their ids.

Which vocabulary strings encode alone as one token is proved beforehand, by merging each of them. A pre-token among
these counts one; only the rest is merged.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Memo, Merges, Splitter
from .common import slices, trim_memory

#: Combining marks after Unicode 9, and one half of a composition. The library's normal form knows none.
LATER_MARKS = (
    (0x7FD, 0x7FD), (0x898, 0x89F), (0x8CA, 0x8D3), (0x9FE, 0x9FE), (0xC3C, 0xC3C), (0xD3B, 0xD3C), (0xEBA, 0xEBA), (0x1715, 0x1715), (0x1ABF, 0x1ACE),
    (0x1DF6, 0x1DFA), (0xA82C, 0xA82C), (0x10D24, 0x10D27), (0x10EAB, 0x10EAC), (0x10EFD, 0x10EFF), (0x10F46, 0x10F50), (0x10F82, 0x10F85), (0x11070, 0x11070),
    (0x1133B, 0x1133B), (0x1145E, 0x1145E), (0x11839, 0x1183A), (0x11930, 0x11930), (0x1193D, 0x1193E), (0x11943, 0x11943), (0x119E0, 0x119E0), (0x11A34, 0x11A34),
    (0x11A47, 0x11A47), (0x11A99, 0x11A99), (0x11D42, 0x11D42), (0x11D44, 0x11D45), (0x11D97, 0x11D97), (0x11F41, 0x11F42), (0x16FF0, 0x16FF1), (0x1E08F, 0x1E08F),
    (0x1E130, 0x1E136), (0x1E2AE, 0x1E2AE), (0x1E2EC, 0x1E2EF), (0x1E4EC, 0x1E4EF),
)
#: Lower case of Unicode 17 that the tables of Unicode 15.1 do not have.
LATER_LOWER = {
    0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B,
    **{c: c + 0x20 for c in range(0x10D50, 0x10D66)}, **{c: c + 0x1B for c in range(0x16EA0, 0x16EB9)},
}
_MARKS = re.compile("([" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in LATER_MARKS) + "])")
_CAPITALS = re.compile("[" + "".join(map(chr, LATER_LOWER)) + "]")


def normal_form(text: str) -> str:
    """Lower-case NFC, by the tables of the library."""
    if text.isascii():
        return text.lower()
    if _MARKS.search(text):  # these neither move nor compose: what is between them is normalised by itself
        text = "".join(unicodedata.normalize("NFC", x) for x in _MARKS.split(text))
    else:
        text = unicodedata.normalize("NFC", text)
    # lower() has a form of its own for a final sigma, which character by character there is not
    text = text.replace("Σ", "σ").lower()
    return text.translate(LATER_LOWER) if _CAPITALS.search(text) else text


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself, or for the others the next from code point 256 on."""
    own = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    others = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(others)) for b in range(256)]


class WordBPE:
    """Counts tokens of a lower-casing BPE whose words end in a suffix, as a tokenizer file describes it."""

    def __init__(self, merges: list[tuple[str, str]], vocab: set[str], suffix: str, pattern: str, special: list[str]):
        alphabet = byte_alphabet()
        self.byte = {c: b for b, c in enumerate(alphabet)}
        symbols: dict[str, int] = {}
        number = lambda x: symbols.setdefault(x, len(symbols))
        for c in [*alphabet, *(c + suffix for c in alphabet)]:
            number(c)  # a byte is its own symbol, and 256 more as the last of a word
        triples = [(number(a), number(b), number(a + b)) for a, b in merges]
        self.merges = Merges({(a, b): i for i, (a, b, _) in enumerate(triples)}, [c for _, _, c in triples], len(symbols))
        self.split = Splitter(pattern)
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.single = {w for v in vocab if v.endswith(suffix) and (w := self._word(v.removesuffix(suffix))) is not None and self._merged(w) == 1}
        self.memo = Memo(self._count_piece)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "memo"}

    def __setstate__(self, state):
        self.__dict__ = state
        self.memo = Memo(self._count_piece)

    @classmethod
    def from_file(cls, path: str) -> WordBPE:
        with open(path, encoding="utf-8") as f:
            j = json.load(f)
        kinds = [x["type"] for x in j["normalizer"]["normalizers"]]
        first, second = j["pre_tokenizer"]["pretokenizers"]
        if kinds != ["NFC", "Replace", "Lowercase"] or (first["type"], second["type"]) != ("Split", "ByteLevel"):
            raise ValueError(f"{path} describes another kind of tokenizer")
        merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in j["model"]["merges"]]
        return cls(merges, set(j["model"]["vocab"]), j["model"]["end_of_word_suffix"], first["pattern"]["Regex"], [x["content"] for x in j["added_tokens"]])

    def _word(self, coded: str) -> str | None:
        """The text that a vocabulary string stands for; None if its bytes are no text by themselves."""
        try:
            return bytes(self.byte[c] for c in coded).decode()
        except (KeyError, UnicodeDecodeError):
            return None

    def _merged(self, piece: str) -> int:
        raw = piece.encode()
        if not raw:
            return 0
        parts = list(raw)
        parts[-1] += 256
        return len(self.merges.merge(parts))

    def _count_piece(self, piece: str) -> int:
        return 1 if piece in self.single else self._merged(piece)

    def _count_plain(self, text: str) -> int:
        return sum(map(self.memo.__getitem__, self.split.findall(normal_form(text))))

    def count(self, text: str) -> int:
        if self.special is None or not self.special.search(text):
            return self._count_plain(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(map(self._count_plain, parts))


def token_counts(documents: DataFrame, bpe: WordBPE, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes long, n_tokens long, over_limit boolean) of each row: UTF-8 bytes, tokens, n_tokens > limit.

    Strings of special tokens inside a text count one token each. A null or empty text has none. Rows with a null or
    repeated id are rows like others. An empty table gives an empty result; other columns are not read.
    """
    held = documents.sparkSession.sparkContext.broadcast(bpe)  # the vocabulary's size bounds it

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = held.value
        for batch in slices(batches, 2):
            counts = [bpe.count(t) if t else 0 for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])
        trim_memory()

    text = F.col(text_col)
    rows = documents.select(F.col(id_col).alias("doc_id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), text.alias("text"))
    schema = rows.select("doc_id", "n_bytes", F.lit(0).cast("long").alias("n_tokens")).schema
    return rows.mapInArrow(run, schema).withColumn("over_limit", F.col("n_tokens") > limit)
