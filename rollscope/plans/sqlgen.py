"""DuckDB SQL text for the oracle side of each query.

These helpers only *print SQL*; they mirror the column functions so the
oracle is an independent second implementation on another engine (RE2
regexes, DuckDB list functions).  Nothing here runs on the Spark path.
"""
from __future__ import annotations

from collections.abc import Sequence


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def r6(x: str) -> str:
    return f"(round({x}, 6) + 0.0)"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '\\A\\s+|\\s+\\z', '', 'g')"


def think_a(x: str) -> str:
    p = q(r"<think>(.*?)</think>")
    return f"(CASE WHEN regexp_matches({x}, {p}) THEN {strip(f'regexp_extract({x}, {p}, 1)')} ELSE {strip(x)} END)"


def think_b(x: str) -> str:
    p = q(r"(?s)<think[^>]*>(.*?)</think>")
    return f"(CASE WHEN regexp_matches({x}, {p}) THEN {strip(f'regexp_extract({x}, {p}, 1)')} END)"


def answer_a(x: str) -> str:
    return f"regexp_extract({x}, {q('<answer>(.*?)</answer>')}, 1)"


def answer_b(x: str) -> str:
    p = q(r"(?s)<answer>(.*?)</answer>")
    return f"(CASE WHEN regexp_matches({x}, {p}) THEN {strip(f'regexp_extract_all({x}, {p}, 1)[-1]')} END)"


def answer_c(x: str) -> str:
    p = q(r"<answer>(.*?)</answer>")
    return f"(CASE WHEN regexp_matches({x}, {p}) THEN {strip(f'regexp_extract({x}, {p}, 1)')} ELSE {strip(x)} END)"


def norm(x: str) -> str:
    return f"lower(replace(replace({x}, ' ', ''), '_', ''))"


def kv(x: str, pattern: str) -> tuple[str, str]:
    return f"regexp_extract_all({x}, {q(pattern)}, 1)", f"regexp_extract_all({x}, {q(pattern)}, 2)"


def prob(keys: str, vals: str, cls: str) -> str:
    v = f"TRY_CAST({vals}[-list_position(list_reverse({keys}), {q(cls)})] AS DOUBLE)"
    return f"(CASE WHEN {v} BETWEEN 0 AND 1 THEN {v} ELSE 0.0 END)"


def _sum(xs: Sequence[str]) -> str:
    return "(" + " + ".join(xs) + ")"


def kl(p: Sequence[str], qv: Sequence[str]) -> str:
    pc = [f"greatest({x}, 1e-10)" for x in p]
    qc = [f"greatest({x}, 1e-10)" for x in qv]
    ps, qs = _sum(pc), _sum(qc)
    return _sum([f"(({a}) / {ps}) * ln((({a}) / {ps}) / (({b}) / {qs}))" for a, b in zip(pc, qc)])


def mse(p: Sequence[str], qv: Sequence[str]) -> str:
    return f"({_sum([f'(({a}) - ({b})) * (({a}) - ({b}))' for a, b in zip(p, qv)])} / {float(len(p))})"


def hybrid(gt: Sequence[str], pred: Sequence[str], alpha=0.5, beta=0.5) -> str:
    return f"exp(-{alpha} * {kl(gt, pred)} - {beta} * {mse(gt, pred)})"


def cos_mse(gt: Sequence[str], pred: Sequence[str], alpha=0.8, beta=0.2) -> str:
    dot = _sum([f"({a}) * ({b})" for a, b in zip(gt, pred)])
    ng = f"sqrt({_sum([f'({a}) * ({a})' for a in gt])})"
    npred = f"sqrt({_sum([f'({b}) * ({b})' for b in pred])})"
    cos = f"(CASE WHEN {ng} = 0 OR {npred} = 0 THEN 0.0 ELSE {dot} / ({ng} * {npred}) END)"
    off = f"exp(-{_sum([f'({a}) * abs(({a}) - ({b}))' for a, b in zip(gt, pred)])})"
    return f"(abs({cos}) * {alpha} + {off} * {beta})"


def argmax(probs: Sequence[str], classes: Sequence[str]) -> tuple[str, str]:
    best = f"greatest({', '.join(probs)})"
    cases = " ".join(f"WHEN {p} = {best} THEN {q(c)}" for p, c in zip(probs, classes))
    return f"(CASE {cases} END)", best
