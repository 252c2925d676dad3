"""Configuration of the engine: routes, depth, dialogue policies, re-ranking."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass, field
from pathlib import Path

ROUTES = ("lexical", "dense", "structured")
POLICIES = ("none", "fixed", "eig")


@dataclass(frozen=True)
class Config:
    routes: Mapping[str, float] = field(default_factory=lambda: {"lexical": 1.0})  # enabled routes and their weights, in order
    candidate_k: int = 300
    rrf_k: int = 60
    proven_negative_filter: bool = False
    posterior_downweight: bool = False
    portfolio_ranking: bool = False
    explore_exploit: bool = False
    question_policy: str = "none"
    rerank_depth: int = 0  # 0: no re-ranking
    strict_size: bool = False

    def __post_init__(self) -> None:
        if not self.routes:
            raise ValueError("no route is enabled")
        if self.question_policy not in POLICIES:
            raise ValueError(f"unknown question policy: {self.question_policy!r}")

    @staticmethod
    def of(raw: Mapping) -> Config:
        routes = {r: float(raw["routes"][r].get("weight", 1.0)) for r in ROUTES if raw.get("routes", {}).get(r, {}).get("enabled")}
        dialog, llm = raw.get("dialog"), raw.get("llm_rerank", {})
        known = {k: dialog[k] for k in ("proven_negative_filter", "posterior_downweight", "portfolio_ranking", "explore_exploit", "question_policy") if k in (dialog or {})}
        return Config(routes, int(raw.get("candidate_k", 100 if dialog is None else 300)), int(raw.get("rrf_k", 60)), **known, rerank_depth=int(llm.get("candidate_depth", 50)) if llm.get("enabled") else 0)

    @staticmethod
    def read(path: str | Path) -> Config:
        return Config.of(json.loads(Path(path).read_text(encoding="utf-8")))


ALL = {"lexical": 1.0, "dense": 1.0, "structured": 0.5}
_DIALOG = {"proven_negative_filter": True, "posterior_downweight": True}
#: The ablation matrix.
NAMED = {
    "lexical_only": Config({"lexical": 1.0}, 100),
    "lexical_dense_rrf": Config({"lexical": 1.0, "dense": 1.0}, 100),
    "full_rrf": Config(ALL, 100),
    "full_rrf_wide": Config(ALL, 300),
    "proven_negatives": Config(ALL, **_DIALOG),
    "portfolio": Config(ALL, **_DIALOG, portfolio_ranking=True),
    "explore_exploit": Config(ALL, **_DIALOG, portfolio_ranking=True, explore_exploit=True),
    "fixed_question": Config(ALL, **_DIALOG, portfolio_ranking=True, explore_exploit=True, question_policy="fixed"),
    "eig_questioning": Config(ALL, **_DIALOG, portfolio_ranking=True, explore_exploit=True, question_policy="eig"),
    "eig_no_exclusion": Config(ALL, portfolio_ranking=True, explore_exploit=True, question_policy="eig"),
    "llm_no_key_fallback": Config(ALL, portfolio_ranking=True, explore_exploit=True, question_policy="eig", rerank_depth=50),
}
