"""Token counts with a whole-token shortcut.

Offline proof: every vocabulary string is decoded to text; it is proven if the
pre-tokeniser leaves it in one piece and the tokenizer encodes it alone as
exactly one token. A pre-token that equals a proven string is one token in any
text, because byte-level BPE never merges across pre-tokens. So counting needs
no merge for proven pre-tokens; only the rest go through the tokenizer's merges,
each distinct one once while a bounded memo holds it.

The pre-token pattern is applied with the regex library. Texts with characters
on which two Unicode tables might disagree about letters, numbers or white
space, and texts that hold a special token's string, take the tokenizer itself
for the whole text, so counts equal the library's for any input.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODEL = "byte_bpe_50k.json"
LIMIT = 1024
#: Bytes of pre-tokens a worker remembers, and characters of those too long to be remembered.
MEMO_BYTES, MEMO_PART = 64 << 20, 64
#: The pre-token pattern of byte-level BPE files with use_regex.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters whose class is old and stable: ASCII without the separators 1C-1F, Latin, Greek, Cyrillic letters and common punctuation.
UNSURE = re.compile(r"[^\x00-\x1b\x20-\x7e\xa1-\xac\xae-ͷ΄-ΊΣ-ҁҊ-ԯ‐-‧‰-⁞€]")


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in characters of byte-level vocabularies, each with its byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def prove(tokenizer, pattern) -> frozenset[str]:
    """The vocabulary strings that are one pre-token and alone encode as one token."""
    back = byte_alphabet()
    texts = []
    for token in tokenizer.get_vocab(with_added_tokens=False):
        try:
            text = bytes(back[c] for c in token).decode()
        except (KeyError, UnicodeDecodeError):
            continue
        if not UNSURE.search(text) and pattern.fullmatch(text) and pattern.findall(text) == [text]:
            texts.append(text)
    return frozenset(t for t, e in zip(texts, tokenizer.encode_batch(texts, add_special_tokens=False), strict=True) if len(e.ids) == 1)


class Counter:
    """Counts tokens as the tokenizer file at path gives them."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.find = regex.compile(PATTERN).findall
        self.proven = prove(self.tokenizer, regex.compile(PATTERN))
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, added))) if added else None
        self.memo, self.held = dict.fromkeys(self.proven, 1), 0
        self.merge = self.tokenizer.model.tokenize
        self.alphabet = {b: c for c, b in byte_alphabet().items()}

    def whole(self, text: str) -> int:
        return len(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def part(self, token: str) -> int:
        """Tokens of a pre-token that is no proven string: the file's merges on its bytes."""
        return len(self.merge(token.encode().decode("latin-1").translate(self.alphabet)))

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if (self.special and self.special.search(text)) or (not text.isascii() or not text.isprintable()) and UNSURE.search(text):
            return self.whole(text)
        parts = self.find(text)
        memo = self.memo
        found = list(map(memo.get, parts))
        if None in found:
            if self.held > MEMO_BYTES:
                self.memo, self.held = dict.fromkeys(self.proven, 1), 0
                memo = self.memo
            at = -1
            for _ in range(found.count(None)):
                at = found.index(None, at + 1)
                n = memo.get(parts[at])
                if n is None:
                    n = self.part(parts[at])
                    if len(parts[at]) <= MEMO_PART:
                        memo[parts[at]] = n
                        self.held += 2 * len(parts[at]) + 150
                found[at] = n
        return sum(found)


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    """One counter per worker process and file."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return Counter(path)


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit per row of docs.

    Null and empty texts have 0 bytes and 0 tokens; texts of any length count whole;
    repeated rows stay; a null doc_id stays null; an empty table gives no rows; other columns of docs are ignored. path is
    a tokenizer file that every executor can read.
    """

    def run(batches):
        count = counter(path).count
        for b in batches:
            texts = b.column(1)
            n = [count(t) for t in texts.to_pylist()]
            size = [len(t or b"") for t in texts.cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int64()), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)


def query(spark, sf_dir: str) -> DataFrame:
    """op9: token counts of all documents with the 50k byte-level vocabulary."""
    import public_tokenizers

    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path(MODEL))
