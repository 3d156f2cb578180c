"""A small plain-Python model of sessions, to compare Spark results with."""

from __future__ import annotations


def kind(r: dict) -> str:
    if r["type"] == "assistant":
        return "assistant"
    content = r.get("message", {}).get("content")
    blocks = [{"type": "text", "text": content}] if isinstance(content, str) else [b for b in content or [] if isinstance(b, dict)]
    if r.get("isCompactSummary"):
        return "compact_summary"
    if r.get("isMeta"):
        return "meta"
    if blocks and blocks[0].get("type") == "tool_result":
        return "tool_result"
    if blocks and blocks[0].get("type") == "text" and blocks[0].get("text", "").startswith("<command-"):
        return "command"
    return "user_prompt"


def tree(records: list[dict]) -> dict[int, dict]:
    """Line number -> parent line, depth, position, interval end (None off the tree)."""
    bounds = {}
    talk = []
    for n, r in enumerate(records):
        if r["type"] == "system" and r.get("subtype") == "compact_boundary" and r.get("uuid"):
            if (r.get("logicalParentUuid") or "").strip():
                bounds[r["uuid"]] = r["logicalParentUuid"].strip()
        elif r["type"] in ("user", "assistant"):
            talk.append(n)

    def hop(u):
        for _ in range(16):
            if bounds.get(u, u) == u:
                return u
            u = bounds[u]
        return u

    where = {records[n]["uuid"]: n for n in talk if records[n].get("uuid")}
    parent = {n: where.get(hop(records[n].get("parentUuid") or "")) for n in talk}
    kids: dict = {}
    for n in talk:
        kids.setdefault(parent[n], []).append(n)
    out = {n: {"parent": parent[n], "depth": None, "pos": None, "end": None} for n in talk}
    counter = 0

    def visit(n, depth):
        nonlocal counter
        out[n]["depth"], out[n]["pos"] = depth, counter
        counter += 1
        for k in kids.get(n, []):
            visit(k, depth + 1)
        out[n]["end"] = counter

    for root in kids.get(None, []):
        visit(root, 0)
    return out


def chunks(kinds: list[str], size: int) -> list[int]:
    numbers, held, at = [], 0, 0
    for k in kinds:
        if k == "user_prompt" and held >= size:
            at, held = at + 1, 0
        held += 1
        numbers.append(at)
    return numbers


def hidden(records, laid_out, include_agents=False, compact_first=False) -> set[int]:
    gone = set()
    order = sorted((v["pos"], n) for n, v in laid_out.items() if v["pos"] is not None)
    for pos, n in order:
        cut_self = bool(records[n].get("isSidechain")) and not include_agents
        if compact_first and records[n].get("isCompactSummary"):
            cut_self = False
        inside = [m for p, m in order if pos <= p < laid_out[n]["end"]]
        if cut_self:
            gone.update(inside)
        elif records[n].get("isCompactSummary"):
            gone.update(m for m in inside if m != n)
    return gone
