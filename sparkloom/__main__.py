"""Command line: python -m sparkloom extract|map|index|ask|document ..."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import docs, index, mapping
from .plans import entries, trace
from .plans.providers import generator


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sparkloom")
    sub = p.add_subparsers(dest="command", required=True)
    for name, said in (("extract", "source tree to class files"), ("map", "source tree to mapped methods"), ("index", "source tree to an index"), ("document", "source tree to documentation files")):
        s = sub.add_parser(name, help=said)
        s.add_argument("folder")
        s.add_argument("output")
    s = sub.add_parser("ask", help="answer a question from an index")
    s.add_argument("output", metavar="index")
    s.add_argument("question")
    for s in sub.choices.values():
        s.add_argument("--provider", help="a model; without one there are stand-ins")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> str:
    a = parser().parse_args(argv)
    trace.configure()
    spark = spark or SparkSession.builder.getOrCreate()
    generate = generator(a.provider) if a.provider else None
    with trace.span(a.command):
        if a.command == "ask":
            found = index.read_index(spark, a.output)
            if found is None:
                raise SystemExit(f"no index: {a.output}")
            if generate is None:
                said = "\n---\n".join(r["content"] for r in entries.retrieve(found, a.question).collect())
            else:
                said = entries.answer(found, a.question, generate).first()["answer"] or "no answer"
            print(said)
            return said
        methods = entries.methods_of(spark, a.folder)
        if a.command == "extract":
            docs.save_classes(methods, a.output)
        elif a.command == "map":
            mapping.mapped_json(mapping.by_class(entries.map_project(spark, a.folder))).write.mode("overwrite").text(a.output)
        elif a.command == "index":
            entries.build_index(methods, entries.map_project(spark, a.folder), a.output).show()
        else:
            d = entries.document_methods(methods.withColumn("ord", F.xxhash64("path", "method_definition")), entries.map_project(spark, a.folder), generate)
            docs.save_documentation(d, a.output).show()
    return a.output


if __name__ == "__main__":
    main()
