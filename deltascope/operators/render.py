"""Texts for people, from rows that are already limited: reports and search results."""

from __future__ import annotations

from pyspark.sql import Row

ICONS = {"added": "+", "deleted": "-", "modified": "~", "moved": ">", "renamed": "r"}
LEVELS = ("critical", "high", "medium", "low")


def _groups(groups: list[Row]) -> list[str]:
    """Groups are listed only where there are several."""
    return [f"[{g.group_id}] {g.label} ({g.size} entities)" for g in groups] if len(groups) > 1 else []


def _counts(entities: list[Row]) -> dict[str, int]:
    return {x: sum(e.risk_level == x for e in entities) for x in LEVELS}


def markdown(entities: list[Row], verdict: str, groups: list[Row] = (), timing: dict[str, int] | None = None) -> str:
    """Header, groups, a table by risk, details from high risk on, and timing."""
    if not entities:
        return "No entity-level changes found."
    out = [f"# {len(entities)} entities changed", "", " | ".join([f"**Verdict:** {verdict}", *(f"**{x.title()}:** {n}" for x, n in _counts(entities).items())])]
    if lines := _groups(groups):
        out += ["", f"## Groups ({len(lines)})", "", *(f"- {x}" for x in lines)]
    out += ["", "## Entities (by risk)", "", "| risk | type | entity | file | score | class | blast | change |", "|---|---|---|---|---|---|---|---|"]
    out += [f"| {e.risk_level.upper()} | {e.entity_type} | `{e.entity_name}` | `{e.file_path}` | {e.risk_score:.2f} | {e.classification} | {e.blast_radius} | {e.change_type} |" for e in entities]
    if risky := [e for e in entities if e.risk_level in ("critical", "high")]:
        out += ["", "## Details"]
        for e in risky:
            out += ["", f"### {e.entity_name} ({e.risk_level})", "", f"- score {e.risk_score:.2f}, blast radius {e.blast_radius}, {e.dependent_count} dependents, {e.dependency_count} dependencies"]
            out += ["- public API"] * bool(e.is_public_api) + ["- cosmetic only"] * (e.structural_change is False)
    if timing and timing.get("total_ms"):
        out += ["", f"_{timing['total_ms']} ms: " + ", ".join(f"{k.removesuffix('_ms')} {v}" for k, v in timing.items() if k != "total_ms") + "_"]
    return "\n".join(out)


def terminal(entities: list[Row], verdict: str, groups: list[Row] = (), timing: dict[str, int] | None = None, context: bool = False) -> str:
    """The same for a terminal: an icon for the change, signals and, on request, what is affected."""
    if not entities:
        return "No entity-level changes found."
    out = [f"{len(entities)} entities, {verdict}: " + ", ".join(f"{n} {x}" for x, n in _counts(entities).items())]
    if lines := _groups(groups):
        out += ["", f"{len(lines)} logical groups:", *(f"  {x}" for x in lines)]
    for e in entities:
        out += ["", f"  {ICONS.get(e.change_type, '?')} {e.risk_level.upper()} {e.entity_type} {e.entity_name} ({e.file_path})"]
        out += [f"    class: {e.classification}  score: {e.risk_score:.2f}  blast: {e.blast_radius}  deps: {e.dependency_count}/{e.dependent_count}"]
        out += ["    public API"] * bool(e.is_public_api) + ["    cosmetic only"] * (e.structural_change is False)
        if context:
            out += [f"    >>> {e.dependent_count} dependents may be affected"] * (e.dependent_count > 0) + [f"    <<< depends on {e.dependency_count} other entities"] * (e.dependency_count > 0)
    if timing and timing.get("total_ms"):
        out += ["", f"{timing['total_ms']} ms"]
    return "\n".join(out)


def matches(rows: list[Row]) -> str:
    """Search results as file:line:text with context lines, a blank line between files, and the totals."""
    if not rows:
        return "No matches found."
    out: list[str] = []
    for i, r in enumerate(rows):
        if i and r.file != rows[i - 1].file:
            out.append("")
        before = r.before.split("\n") if getattr(r, "before", "") else []
        after = r.after.split("\n") if getattr(r, "after", "") else []
        out += [f"{r.file}:{r.line - len(before) + j}- {x}" for j, x in enumerate(before)]
        out.append(f"{r.file}:{r.line}:{r.text}")
        out += [f"{r.file}:{r.line + 1 + j}- {x}" for j, x in enumerate(after)]
    return "\n".join([*out, "", f"{len(rows)} matches across {len({r.file for r in rows})} files"])
