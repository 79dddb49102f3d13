"""All oracle SQL strings by query name."""


def all_sql() -> dict[str, str]:
    from pathweave.oracle import web, game, primitives, reports, catalog, segments
    out: dict[str, str] = {}
    for m in (web, game, primitives, reports, catalog, segments):
        out.update(m.SQL)
    return out
