"""Reports for people, from small results: at most a row for each run and k, a few failures, or one summary.

Everything that grows with the corpus is aggregated before it comes here.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame

from ..config import HINTS


def _table(head: list[str], rows: list[list[str]]) -> list[str]:
    return [f"| {' | '.join(r)} |" for r in (head, ["---"] * len(head), *rows)]


def evaluation(metrics: DataFrame, counts: DataFrame, failures: DataFrame, warnings: DataFrame, meta: dict[str, str] | None = None, form: str = "markdown") -> str:
    """Metrics of the runs side by side, how many items they rest on, reasons to distrust them, and failures with their best hits."""
    if form not in ("markdown", "json"):
        raise ValueError("a report is markdown or json")
    measured = sorted((r.asDict() for r in metrics.collect()), key=lambda r: (r.get("run", ""), r["k"]))
    total, said = counts.first().asDict(), list(warnings.first().warnings)
    failed: dict[str, list[dict]] = {}
    for r in failures.orderBy("qid", "rank").collect():
        failed.setdefault(str(r.qid), []).append(r.asDict())
    if form == "json":
        return json.dumps({"meta": meta or {}, "counts": total, "metrics": measured, "warnings": said, "failures": failed}, ensure_ascii=False, indent=2)
    out = ["# Retrieval evaluation", ""]
    out += [f"- {name}: {value}" for name, value in {**(meta or {}), **total}.items()]
    names = ["recall", "hit_rate", "mrr", "ndcg"]
    out += ["", "## Metrics", "", *_table(["run", "k", *names], [[r.get("run", "-"), str(r["k"]), *(f"{r[n]:.3f}" for n in names)] for r in measured])]
    if said:
        out += ["", "## Warnings", "", *(f"- {w}" for w in said)]
    if failed:
        out += ["", "## Failures", ""]
        for qid, hits in failed.items():
            rank = hits[0]["first_rank"]
            out.append(f"- {qid}: " + (f"first match at rank {rank}" if rank else "no match"))
            out += [f"  - #{h['rank']} {h['score']:.4f} {h['snippet']}" for h in hits if h["rank"] is not None]
    return "\n".join(out) + "\n"


def anchors(golden: DataFrame, missing: DataFrame) -> str:
    """Result of the anchor check."""
    n = golden.selectExpr("count(*) AS items", "count_if(answerable) AS answerable", "count_if(reviewed) AS reviewed", "coalesce(sum(size(anchors)), 0) AS anchors").first()
    rows = missing.orderBy("qid", "anchor").collect()
    out = ["# Anchor check", "", f"- items: {n.items} ({n.answerable} answerable, {n.reviewed} reviewed)", f"- anchors: {n.anchors}, of which {len(rows)} match nothing in the index"]
    out += [f"- {r.qid}, anchor {r.anchor}: " + (f"half of it stands in {', '.join(r.near)}" if r.near else "nothing like it was found") for r in rows]
    return "\n".join(out) + "\n"


def index_summary(summary: DataFrame) -> str:
    """Counters of an index run, with what to do about files that were left out."""
    r = summary.first()
    out = [f"indexed: {r.parents} parents, {r.children} children; skipped {r.skipped}, deleted {r.deleted}"]
    out += [f"  without content: {r.empty}"] * bool(r.empty)
    out += [f"  not indexed, {n}: {HINTS.get(reason, reason)}" for reason, n in sorted((r.unsupported_reasons or {}).items())]
    out += [f"  degraded, {r.degraded}: {HINTS['degraded']}"] * bool(r.degraded)
    return "\n".join(out) + "\n"


def answers(rows: DataFrame, limit: int = 20) -> str:
    """Answers with their sources and the check of their citations; the first ``limit`` by question."""
    out = []
    for r in rows.orderBy("qid").limit(limit).collect():
        out.append(f"## {r.qid}")
        if r.refused:
            out += [f"refused: {r.refusal_reason}", r.text, *([f"(the model said: {r.raw_text[:120]})"] if r.raw_text else [])]
            continue
        v = r.validation
        out += [r.text, *(f"[{c.ref}] {c.source}{f' / {c.heading}' if c.heading else ''}" for c in r.citations)]
        out.append(f"citations: {len(v.valid_refs)} valid, invalid {list(v.invalid_refs)}, unused {list(v.unused_refs)}, coverage {v.coverage:.0%}")
    return "\n".join(out) + "\n"


def save(text: str, spark, path: str) -> None:
    """Writes a report as one text file in a folder that Spark can reach."""
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").option("lineSep", "").text(path)
