"""Results to files: a document per line for any size, or the one-file form with summary and candidates."""

from __future__ import annotations

import json
import os

from pyspark.sql import functions as F

from braidwork.operators.project import project


def write_lines(projected, path: str, mode: str = "overwrite") -> None:
    """JSON lines, in parallel."""
    projected.write.mode(mode).json(path, ignoreNullFields=False)


def write_document(result, path: str, pretty: bool = True) -> None:
    """{summary, candidates} in one UTF-8 file on the driver's machine; rows stream through, they are never all in memory."""
    counts = result.summary.first().asDict()
    rejected = []
    for r in result.rejections.orderBy("rec_id", "pos").toLocalIterator():
        row = {"field": r["field"], "reason_code": r["reason_code"], "reason": r["reason"]}
        rejected.append(row | ({"raw_value": r["raw_value"]} if r["raw_value"] else {}))
    counts["validation_rejections"] = rejected
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    df = project(result.profiles.orderBy("cluster_id"), result.projection)
    lines = df.select("json") if df.columns == ["candidate_id", "json"] else df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))
    indent = 2 if pretty else None
    with open(path, "w", encoding="utf-8") as f:
        f.write('{"summary": ' + json.dumps(counts, ensure_ascii=False, indent=indent) + ', "candidates": [')
        for i, row in enumerate(lines.toLocalIterator()):
            f.write(("," if i else "") + ("\n" if pretty else "") + json.dumps(json.loads(row["json"]), ensure_ascii=False, indent=indent))
        f.write("]}\n")


def describe(result, rows: int = 20) -> str:
    """A short text for people: counts and the first profiles."""
    out = [", ".join(f"{k}: {v}" for k, v in result.summary.first().asDict().items())]
    for p in result.profiles.orderBy("cluster_id").limit(rows).collect():
        out.append(f"{p.candidate_id}  {p.full_name or '-'}  [{p.status}]  confidence {p.overall_confidence:.3f}, quality {p.data_quality_score:.3f}")
        out.append(f"  emails {', '.join(p.emails)}; phones {', '.join(p.phones)}; skills {', '.join(s.name for s in p.skills[:5])}")
        out += [f"  {d.field}: {d.reason_human}" for d in p.field_decisions[:4]]
        out += [f"  review: {r}" for r in p.review_reasons]
    return "\n".join(out)
