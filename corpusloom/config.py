"""Settings of the corpus operators, with environment overrides of the same names."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Settings:
    min_words: int = 100
    near_dup_threshold: float = 0.8
    eval_fraction: float = 0.1
    unseen_fraction: float = 0.05
    seed: int = 42
    block_size: int = 2048
    instruction_train_fraction: float = 0.8
    max_pairs_per_doc: int = 150
    shingle_words: int = 5
    language: str = "en"

    def override(self, **changes) -> Settings:
        return replace(self, **changes)

    @classmethod
    def from_env(cls) -> Settings:
        """Defaults, with MIN_WORDS, BLOCK_SIZE and so on from the environment, cast to the default's type."""
        found = {f.name: type(f.default)(os.environ[f.name.upper()]) for f in fields(cls) if f.name.upper() in os.environ}
        return cls(**found)
