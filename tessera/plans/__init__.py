"""All named queries with their SQL."""


def all_plans() -> dict:
    """name -> (callable of (spark, sf_dir), SQL or None)."""
    from tessera.plans import analysis, breakdowns, execution, planning, records, reports, schemas, scoring, statistics, streams, tables

    out: dict = {}
    for module in (scoring, statistics, reports, records, schemas, tables, analysis, streams, execution, planning, breakdowns):
        out |= module.PLANS
    return out
