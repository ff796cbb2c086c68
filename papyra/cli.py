"""Command line over the library: corpus commands, report steps with a client of your own, checks and export.

``python -m papyra.cli COMMAND ...``; ``help-all`` prints every command's options. Steps that ask a model take
``--client module:maker`` (a function without arguments that returns one from prompt to answer); the default is the stub.
"""

from __future__ import annotations

import argparse
import importlib
from pathlib import Path

from pyspark.sql import functions as F

from papyra.operators import assembly, knowledge, modes, steps
from papyra.session import local_session
from papyra.sources import files, sinks

#: Commands whose step rewrites the chapters of a report, with the task they set.
CHAPTER_STEPS = {"report-v2": "Revise.", "report-final": "Turn into prose.", "report-v4": "Add citations.", "report-policy": "Restyle.", "expert-polish": "Polish."}
ROLES = {"facts": "Check facts and logic.", "structure": "Judge structure and depth.", "feasibility": "Judge feasibility.", "invention": "List inventions under 【幻觉清单】.", "style": "Judge the style."}


def client_of(name: str):
    module, _, maker = name.partition(":")
    return getattr(importlib.import_module(module), maker)


def one_row(spark, path: str):
    return spark.createDataFrame([(Path(path).stem, sinks.load_text(path, 0))], "base string, text string")


def preprocess(spark, a) -> str:
    raw = files.corpus_dir(spark, a.input, a.recursive)
    docs = raw.withColumn("file_id", F.xxhash64("filepath"))
    index = Path(a.input) / "_index.csv"
    status = files.status_csv(spark, str(index)) if index.is_file() else spark.createDataFrame([], "line_id long, filename string, status string")
    names = dict(x.split("=", 1) for x in a.entity)
    return modes.mode_text(docs, status, a.mode, knowledge.by_dictionary(names))


def merged(spark, a) -> str:
    rows = files.corpus_files(spark, a.input, a.recursive)
    return "\n\n".join(f"--- 来自文件: {r.filename} ---\n\n{r.text}" for r in rows.toLocalIterator())


def imported(spark, a) -> str:
    return files.corpus_files(spark, a.input).first().text


def chapters(spark, a) -> str:
    rep = one_row(spark, a.input)
    ch = assembly.report_chapters(rep, "base", "text")
    step = steps.compressed(ch, "base", client_of(a.client)) if a.command == "report-v5" else steps.per_chapter(ch, "base", CHAPTER_STEPS[a.command], client_of(a.client))
    head = assembly.split_report(rep, "base", "text").first().header
    title = lambda t: t if t.startswith("#") else "## " + t
    return "\n\n".join([*([head] if head else []), *[f"{title(r.title)}\n\n{r.body}" for r in step.orderBy("chap_ord").collect()]])


def report(spark, a) -> str:
    rep = one_row(spark, a.input)
    if a.command == "report-v3":
        found = steps.structures(rep, "base", "text", client_of(a.client)).first().chapters
        return "\n\n".join(f"# {c.num}、{c.title}" for c in found)
    return steps.full_report(rep, "base", "text", client_of(a.client), ROLES, [] if a.command == "report-v1" else None).first().report


def checks(spark, a) -> str:
    rep, client = one_row(spark, a.input), client_of(a.client)
    if a.command == "consistency-check":
        return steps.consistency(rep, "base", "text", client).first().report
    if a.command == "quality-eval":
        return str(steps.quality(rep, "base", "text", client).first().asDict())
    if a.command == "expert-eval":
        return "\n".join(f"{r.dimension}: {r.score}" for r in steps.evaluations(rep, "base", "text", list(ROLES), client).collect())
    if a.command == "experts":
        return steps.experts(rep, "base", "text", ROLES, client)[1].first().opinion
    now, old = steps.claims(rep, "base", "text", client), steps.claims(one_row(spark, a.against).withColumn("base", F.lit(Path(a.input).stem)), "base", "text", client)
    return str(assembly.drift(old, now, "base").first().asDict())


def research(spark, a) -> str:
    topics = spark.createDataFrame([(a.input, a.input)], "base string, topic string")
    row = steps.research(topics, "base", "topic", client_of(a.client), client_of(a.client))[1].first()
    return row.report if row else ""


def export(spark, a) -> str:
    return sinks.to_html(sinks.load_text(a.input, 0))


COMMANDS = {
    "preprocess": preprocess, "batch": preprocess, "merge": merged, "import": imported, "fetch": imported, "export": export, "deep-research": research,
    **dict.fromkeys([*CHAPTER_STEPS, "report-v5"], chapters), **dict.fromkeys(["report-v1", "report-v3", "full-report", "all", "all-v3"], report),
    **dict.fromkeys(["consistency-check", "quality-eval", "expert-eval", "experts", "drift-check"], checks),
}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="papyra")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("help-all")
    for name in COMMANDS:
        c = sub.add_parser(name)
        c.add_argument("input")
        c.add_argument("-o", "--output", default="")
        c.add_argument("--client", default="papyra.operators.external:stub")
        if COMMANDS[name] in (preprocess, merged):
            c.add_argument("--recursive", action="store_true")
        if COMMANDS[name] is preprocess:
            c.add_argument("--mode", choices=["A", "B", "AB"], default="A")
            c.add_argument("--entity", action="append", default=[], metavar="NAME=LABEL")
        if name == "drift-check":
            c.add_argument("--against", required=True)
    return p


def main(argv: list[str] | None = None, spark=None) -> str:
    p = parser()
    a = p.parse_args(argv)
    if a.command == "help-all":
        subs = next(x for x in p._actions if isinstance(x, argparse._SubParsersAction))
        text = "\n\n".join(c.format_help() for c in subs.choices.values())
    else:
        text = COMMANDS[a.command](spark or local_session(), a)
        if a.output:
            sinks.write_text(a.output, text)
    print(text[:2000])
    return text


if __name__ == "__main__":
    main()
