"""Token ids by a byte-level BPE file, and training of one on a bounded sample."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuswright.functions.text import is_blank, sanitize, training_pieces

#: Special tokens, with ids 0 to 3.
SPECIALS = ("<unk>", "<s>", "</s>", "<pad>")


@cache
def _load(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def encode(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Add ids (null where the text can't be encoded or an id needs over 16 bits; empty for blank text), without begin or end tokens.

    The file is loaded once for each worker; a text that the library refuses counts as unencodable and stops nothing.
    """
    schema = docs.withColumn("ids", F.array(F.lit(0))).schema

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizer = _load(path)

        def one(value: str | None) -> list[int] | None:
            if value is None or not value.strip():
                return []
            try:
                ids = tokenizer.encode(value, add_special_tokens=False).ids
            except Exception:
                return None
            return ids if not ids or max(ids) <= 0xFFFF else None

        for pdf in frames:
            yield pdf.assign(ids=[one(t) for t in pdf[text]])

    return sanitize(docs, text).mapInPandas(run, schema)


def with_end(ids, end: int):
    """ids and an end token; null or empty ids stay as they are."""
    return F.when(F.size(ids) > 0, F.concat(ids, F.array(F.lit(end)))).otherwise(ids)


def training_corpus(docs: DataFrame, text: str = "text") -> DataFrame:
    """The pieces that a tokenizer is trained on, one in a row."""
    return docs.where(~is_blank(text)).select(F.explode(training_pieces(text)).alias("piece"))


def train_bpe(pieces: list[str], vocabulary: int = 32_000, least: int = 1):
    """A byte-level BPE of a sample that the caller has bounded (see take_chars)."""
    from tokenizers import Tokenizer, decoders, models, pre_tokenizers, trainers

    tokenizer = Tokenizer(models.BPE(unk_token=SPECIALS[0]))
    tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False)
    tokenizer.decoder = decoders.ByteLevel()
    tokenizer.train_from_iterator(pieces, trainers.BpeTrainer(vocab_size=vocabulary, min_frequency=least, special_tokens=list(SPECIALS), initial_alphabet=pre_tokenizers.ByteLevel.alphabet(), show_progress=False))
    return tokenizer


def round_trips(tokenizer, text: str) -> bool:
    """Does decoding give the text again, spaces aside?"""
    return "".join(tokenizer.decode(tokenizer.encode(text).ids).split(" ")) == "".join(text.split(" "))


def decoded_samples(windows: DataFrame, path: str, tokens: int = 256, chars: int = 800) -> DataFrame:
    """file, sample: the text of the first tokens of each file's first window."""
    first = windows.where("window = 0").select("file", F.slice("tokens", 1, tokens).alias("ids"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizer = _load(path)
        for pdf in frames:
            yield pd.DataFrame({"file": pdf["file"], "sample": [tokenizer.decode(list(x))[:chars] for x in pdf["ids"]]})

    return first.mapInPandas(run, "file string, sample string")
