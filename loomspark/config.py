"""Settings of the curation engine: driver-side, immutable, unknown keys rejected."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields, replace

#: The weights of the score's components, in the order in which they are summed.
WEIGHTS = {"keyword": 0.30, "length": 0.25, "lexical": 0.15, "dialogue": 0.10, "paragraph": 0.10, "punctuation": 0.05, "repetition": 0.05}

#: The facets of tags, in their order.
FACETS = ("situation", "interactions", "appearance", "actions", "setting", "tone", "dynamics")


@dataclass(frozen=True)
class Curation:
    """Fixed defaults of every step; ``updated`` and ``load`` override them."""

    min_keyword_hits: int = 2
    target_tokens: int = 1400
    min_tokens: int = 200
    max_tokens: int = 1800
    chars_per_token: float = 4.0
    split_enabled: bool = True
    weights: dict = field(default_factory=lambda: dict(WEIGHTS))
    target_keyword_hits: int = 4
    target_dialogue_ratio: float = 0.35
    target_paragraph_tokens: int = 60
    dedup_exact: bool = True
    near_dup_threshold: float = 0.85
    minhash_perm: int = 64
    minhash_k: int = 5
    diversity_enabled: bool = True
    diversity_lambda: float = 0.5
    max_examples: int = 0
    val_frac: float = 0.02
    seed: int = 42

    def updated(self, **changes) -> Curation:
        known = {f.name for f in fields(self)}
        if unknown := set(changes) - known:
            raise KeyError(f"unknown settings: {sorted(unknown)}")
        if "weights" in changes:
            if unknown := set(changes["weights"]) - set(WEIGHTS):
                raise KeyError(f"unknown weights: {sorted(unknown)}")
            changes["weights"] = self.weights | changes["weights"]
        return replace(self, **changes)


def load(path: str, depth: int = 10) -> Curation:
    """A JSON file of settings; its key ``extends`` names a file that it overrides, to a depth of ten."""
    import os

    chain = []
    while path:
        if len(chain) == depth:
            raise ValueError("extends: chain is too deep")
        with open(path, encoding="utf-8") as f:
            chain.append(json.load(f))
        base = chain[-1].pop("extends", None)
        path = os.path.join(os.path.dirname(path), base) if base else None
    out = Curation()
    for changes in reversed(chain):
        out = out.updated(**changes)
    return out
