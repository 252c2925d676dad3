"""python -m parley COMMAND --catalog C --dataset D ...: evaluate, ablate, probe, failures, embed."""

from __future__ import annotations

import argparse
import json
from pathlib import Path

from pyspark.sql import SparkSession

from .functions import vocabulary as V
from .operators import metrics
from .plans import report
from .plans.agent import FieldedAgent, Plugged, load
from .plans.config import NAMED, Config
from .plans.engine import Engine
from .plans.replay import replay
from .sources.catalog import read_catalog, read_embeddings, read_samples, upsert_markdown, with_features, write_embeddings, write_json, write_record

#: The name of the agent of weighted fields, which has no configuration.
FIELDED = "bm25_baseline"


def parsed(args: list[str] | None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="parley", description=__doc__)
    parser.add_argument("command", choices=("evaluate", "ablate", "probe", "failures", "embed"))
    parser.add_argument("--catalog", required=True)
    parser.add_argument("--dataset", help="sessions; for all commands but embed")
    parser.add_argument("--name", default="lexical_only", help=f"{FIELDED}, a named configuration, or the label of --config or --agent-import")
    parser.add_argument("--config", help="a JSON configuration")
    parser.add_argument("--agent-import", help="module:Class of an agent with reset and respond, made as Class(catalog path, ...)")
    parser.add_argument("--agent-kwargs", default="{}", help="JSON of its further arguments")
    parser.add_argument("--embeddings", help="a table that embed wrote")
    parser.add_argument("--embed", default="parley.functions.hashing:embed", help="module:function from texts to vectors")
    parser.add_argument("--batch-size", type=int, default=256, help="texts that embed gives the embedder at a time")
    parser.add_argument("--tasks", type=int, help="in how many tasks embed works, as many as the catalog has unless told")
    parser.add_argument("--scorer", help="module:function that re-ranks a table of requests")
    parser.add_argument("--model", default="default", help="the name of the scorer's model, part of the memo's keys")
    parser.add_argument("--memo", help="a table of re-ranker's answers, read and added to")
    parser.add_argument("--k", type=int, default=1000, help="depth of a probe")
    parser.add_argument("--output", default="results.json")
    parser.add_argument("--report", default="ablations.md")
    parser.add_argument("--runs", default="runs", help="where ablate archives the record of each name")
    a = parser.parse_args(args)
    if a.command != "embed" and not a.dataset:
        parser.error("--dataset is needed")
    return a


def stepper(spark: SparkSession, a: argparse.Namespace, catalog):
    if a.agent_import:
        return Plugged(load(a.agent_import)(a.catalog, **json.loads(a.agent_kwargs)), catalog)
    if a.name == FIELDED and not a.config:
        return FieldedAgent(spark, catalog)
    embeddings = read_embeddings(spark, a.embeddings, catalog) if a.embeddings else None
    return Engine(catalog, Config.read(a.config) if a.config else NAMED[a.name], embeddings, load(a.embed), load(a.scorer) if a.scorer else None, a.memo, a.model)


def main(args: list[str] | None = None) -> None:
    a = parsed(args)
    spark = SparkSession.builder.getOrCreate()
    catalog = read_catalog(spark, a.catalog)
    if a.command == "embed":
        write_embeddings(with_features(catalog), a.embeddings or "embeddings", load(a.embed), a.batch_size, a.tasks)
        return
    samples = read_samples(spark, a.dataset)
    results, transcript = replay(stepper(spark, a, catalog), catalog, samples, a.k if a.command == "probe" else V.TOP_K)
    if a.command == "probe":
        found = {"config": a.name, "k": a.k} | metrics.recall_probe(results).first().asDict()
        write_json(a.output, found)
    elif a.command == "failures":
        found = {"missed": results.where("not hit").count(), "sessions": results.count()}
        with open(a.output, "w", encoding="utf-8") as out:
            out.write(f"# Failure dump: {a.name}\n\n{found['missed']}/{found['sessions']} sessions missed.\n")
            for r in report.failures(results, transcript, catalog).orderBy("sample_id").toLocalIterator():
                out.write(f"\n{r.block}")
    else:
        found = metrics.metric_record(results, transcript)
        write_record(a.output, found, results.orderBy("sample_id"))
        if a.command == "ablate":
            write_record(Path(a.runs) / f"{a.name}.json", found, results.orderBy("sample_id"))
            path = Path(a.report)
            text = path.read_text(encoding="utf-8") if path.exists() else "# Ablations\n"
            text = upsert_markdown(text, V.REPORT_HEADER, report.format_row(a.name, found), a.name)
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_text(upsert_markdown(text, V.SCENARIO_HEADER, report.format_scenario_row(a.name, found["scenario_metrics"]), a.name), encoding="utf-8")
    print(json.dumps(found, indent=2))


if __name__ == "__main__":
    main()
