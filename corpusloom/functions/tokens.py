"""Tokenizers from files as column functions, for operators that take any (`blocks.encode`, `blocks.build_packed`)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class FileTokenizer:
    """ids: text to array<int> without special tokens; bos and eos: the ids that documents are wrapped in; size of the vocabulary."""

    ids: Callable[[Column], Column]
    bos: int
    eos: int
    size: int


def load_tokenizer(path: str, bos: str, eos: str) -> FileTokenizer:
    """The tokenizer of a JSON file; ValueError if it lacks one of the two tokens.

    The file is read here and travels with the function (some megabytes), so executors need no path to it; texts are encoded
    in Arrow batches, a null one as an empty one.
    """
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        source = f.read()
    vocabulary = Tokenizer.from_str(source).get_vocab(with_added_tokens=True)
    missing = [t for t in (bos, eos) if t not in vocabulary]
    if missing:
        raise ValueError(f"the tokenizer has no {' and no '.join(missing)}")
    known: dict[str, Tokenizer] = {}

    @F.pandas_udf("array<int>")
    def ids(text: pd.Series) -> pd.Series:
        if "it" not in known:
            known["it"] = Tokenizer.from_str(source)
        return pd.Series([e.ids for e in known["it"].encode_batch(text.fillna("").tolist(), add_special_tokens=False)])

    return FileTokenizer(lambda column: ids(column), vocabulary[bos], vocabulary[eos], len(vocabulary))
