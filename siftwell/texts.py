"""Answers of the engine as plain text, for terminals and tools."""

from __future__ import annotations

from . import constants as C
from .engine import Engine
from .functions import text
from .operators.retrieval import SearchOptions


def search(engine: Engine, query: str, limit: int | None = None, min_score: float | None = None, file_type: str | None = None, symbol_kind: str | None = None) -> str:
    """Numbered results: place, score, symbol and the first characters."""
    types, kinds = (tuple(x) if (x := text.parse_csv(v)) else None for v in (file_type, symbol_kind))
    rows = engine.search(query, text.capped(limit, C.LIMITS["search"], C.LIMITS["tool_cap"]), SearchOptions(min_score, types, kinds)).collect()
    out = [f"{len(rows)} results for '{query.strip()}'"]
    for k, r in enumerate(rows, 1):
        out.append(f"\n{k}. {r['path']}, lines {r['start_line']}-{r['end_line']}, score {r['score']:.2f}")
        if r["symbol_name"]:
            out.append(f"   symbol {r['symbol_name']} ({r['symbol_kind'] or 'unknown'})")
        out.append("   " + (r["content"] or "")[:200].strip())
    return "\n".join(out)


def find_refs(engine: Engine, symbol: str, limit: int | None = None, shown: int = 20) -> str:
    """Definitions by their first line, then the first ``shown`` usages."""
    rows = engine.find_refs(symbol, limit).collect()
    found, used = ([r for r in rows if r["part"] == p] for p in (0, 1))
    out = [f"{len(rows)} references to '{symbol.strip()}'"]
    if found:
        out += ["\nDefinitions:", *(f"  {r['path']}:{r['start_line']}  {(r['content'] or '').partition(chr(10))[0]}" for r in found)]
    if used:
        out += [f"\nUsages ({len(used)}):", *(f"  {r['path']}:{r['start_line']}  {r['content'].strip()}" for r in used[:shown])]
        if len(used) > shown:
            out.append(f"  and {len(used) - shown} more")
    return "\n".join(out)


def dependencies(engine: Engine, path: str) -> str:
    """What a file imports, and which files import it."""
    path = text.validate(path, "PATH")
    if ".." in path:
        raise text.RequestError("PATH_TRAVERSAL", "path leaves the project")
    own, by = engine.dependencies(path).collect(), engine.dependents(path).collect()
    out = [f"Dependencies of '{path}'", f"\nImports ({len(own)}):"]
    out += [f"  {r['target_path']}" + (f" as {r['import_name']}" if r["import_name"] else "") + f" [{r['kind']}]" for r in own]
    return "\n".join([*out, f"\nImported by ({len(by)}):", *(f"  {r['source_path']}" for r in by)])


def explain(engine: Engine, symbol: str, related: int = 10) -> str:
    """Definitions with signature and documentation, the number of usages, related names."""
    r = engine.explain(symbol).first()
    if not r["found"]:
        return f"'{symbol.strip()}' is not in the index"
    out = [f"{r['name']}: {len(r['definitions'])} definitions, {r['usage_count']} usages"]
    for k, d in enumerate(r["definitions"], 1):
        out.append(f"\n{k}. {d['kind']} at {d['path']}:{d['start_line']}-{d['end_line']}")
        out += [f"   {x}" for v in (d["signature"], d["doc_comment"]) if v for x in v.split("\n")]
    if r["related"]:
        out += ["\nRelated:", *(f"  {x}" for x in r["related"][:related])]
    return "\n".join(out)


def stats(engine: Engine) -> str:
    return "\n".join(f"{r['table_name']}: {r['n']}" for r in engine.stats().collect())
