"""Command line: python -m rankloom.cli version | search | ask | info | build-dataset | evaluate | ablate."""

from __future__ import annotations

import argparse
import sys
from dataclasses import asdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom import __version__
from rankloom.config import get_config
from rankloom.functions.text import snippet
from rankloom.plans.engine import Engine
from rankloom.plans.harness import run_ablation, run_harness
from rankloom.runtime import build_session, scratch_scope
from rankloom.sources import dataset
from rankloom.sources.jsonl import (
    CORPUS_FILE,
    QUESTIONS_FILE,
    count_records,
    first_questions,
    load_corpus,
    load_questions,
)


def parser() -> argparse.ArgumentParser:
    main_parser = argparse.ArgumentParser(prog="rankloom")
    commands = main_parser.add_subparsers(dest="command")
    commands.add_parser("version")
    commands.add_parser("info")
    search = commands.add_parser("search")
    search.add_argument("query")
    search.add_argument("-k", "--k", type=int, default=10)
    search.add_argument("--no-rerank", action="store_true")
    ask = commands.add_parser("ask")
    ask.add_argument("question")
    ask.add_argument("-k", "--k", type=int, default=5)
    ask.add_argument("--faithfulness", action="store_true")
    build = commands.add_parser("build-dataset")
    build.add_argument("--rows", help="parquet with src_pos, id, title, context, question, answers")
    build.add_argument("--docs", type=int, default=None)
    build.add_argument("--questions", type=int, default=None)
    build.add_argument("--force", action="store_true")
    evaluate = commands.add_parser("evaluate")
    evaluate.add_argument("--k", type=int, default=10)
    evaluate.add_argument("--setups", nargs="*")
    ablate = commands.add_parser("ablate")
    for command in (evaluate, ablate):
        command.add_argument("--max-questions", type=int, default=None)
        command.add_argument("--out", default=get_config().reports_dir)
    return main_parser


def result_lines(run: DataFrame) -> list[str]:
    """rank, score, document, retriever and snippet of each result (at most k rows)."""
    rows = run.withColumn("snippet", snippet(F.col("text"))).orderBy("rank").collect()
    return [f"{r['rank']:>4}  {r['score']:.4f}  {r['doc_id']}  {r['retriever']}  {r['snippet']}" for r in rows]


def info_lines(spark) -> list[str]:
    config = get_config()
    settings = {**asdict(config), "generation_api_key": config.masked_key()}
    lines = [f"{name}: {value}" for name, value in settings.items()]
    for filename in (CORPUS_FILE, QUESTIONS_FILE):
        path = f"{config.data_dir}/{filename}"
        try:
            lines.append(f"{path}: {count_records(spark, path)} rows")
        except Exception:  # noqa: BLE001 - an unreadable file is reported, not raised
            lines.append(f"{path}: missing")
    return lines


def _run(args: argparse.Namespace, spark) -> None:
    if args.command == "info":
        print("\n".join(info_lines(spark)))
    elif args.command == "search":
        engine = Engine(spark).load(use_rerank=not args.no_rerank)
        print("\n".join(result_lines(engine.search(args.query, args.k))))
    elif args.command == "ask":
        answer = Engine(spark).load().ask(args.question, args.k, args.faithfulness)
        row = answer.first()
        print(row["text"])
        print(f"generator: {row['generator']}  latency: {row['latency_ms']:.1f} ms"
              + (f"  faithfulness: {row['faithfulness']:.3f}" if row["faithfulness"] is not None else ""))
        print("\n".join(result_lines(answer.select(F.inline("supporting_chunks")))))
    elif args.command == "build-dataset":
        rows = spark.read.parquet(args.rows) if args.rows else None
        print(dataset.build_dataset(spark, get_config().data_dir, rows, args.docs, args.questions, args.force))
    elif args.command == "evaluate":
        run_harness(load_corpus(spark), first_questions(load_questions(spark), args.max_questions), args.out, args.setups, args.k)
    elif args.command == "ablate":
        run_ablation(spark, load_corpus(spark), first_questions(load_questions(spark), args.max_questions), args.out).show(20, False)


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command is None:
        parser().print_help()
        return 0
    if args.command == "version":
        print(f"rankloom {__version__}")
        return 0
    try:
        spark = build_session()
        with scratch_scope(spark):
            _run(args, spark)
    except (FileNotFoundError, ValueError, RuntimeError) as error:
        print(f"error: {error}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
