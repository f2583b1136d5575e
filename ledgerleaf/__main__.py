"""python -m ledgerleaf FOLDER [--out PATH] [--json] [--english] [--plan] [--rename] [--ocr MODULE:NAME] [--llm MODULE:NAME --store PATH]: process a folder and print a summary."""

from __future__ import annotations

import argparse
from collections.abc import Callable
from importlib import import_module

from pyspark.sql import SparkSession

from ledgerleaf import api
from ledgerleaf.functions.staging import staged
from ledgerleaf.operators import documents, model_stage, naming, sinks
from ledgerleaf.plans import rules as R
from ledgerleaf.sources import pdf


def named(said: str) -> Callable:
    """The function that MODULE:NAME means."""
    module, _, name = said.partition(":")
    if not module or not name:
        raise argparse.ArgumentTypeError(f"not MODULE:NAME: {said}")
    return getattr(import_module(module), name)


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="ledgerleaf", description="Read the invoices of a folder.")
    parser.add_argument("folder")
    parser.add_argument("--out", help="write the articles here")
    parser.add_argument("--json", action="store_true", help="write documents as a JSON array instead of articles as CSV")
    parser.add_argument("--english", action="store_true", help="with the English header")
    parser.add_argument("--plan", action="store_true", help="show how the files may be renamed")
    parser.add_argument("--rename", action=argparse.BooleanOptionalAction, default=False, help="rename the files of a local folder, and write the table with their new names")
    parser.add_argument("--pattern", default=R.NAME_PATTERNS[0], help="of the new names")
    parser.add_argument("--ocr", type=named, metavar="MODULE:NAME", help="what recognises files without text: of bytes and a language, pages of text")
    parser.add_argument("--llm", type=named, metavar="MODULE:NAME", help="what asks a model: of a request, the response, both JSON")
    parser.add_argument("--store", help="where the model's replies are kept")
    said = parser.parse_args(args)
    if said.llm and not said.store:
        parser.error("--llm needs --store")
    spark = SparkSession.builder.getOrCreate()
    model = model_stage.Model(said.llm, said.store) if said.llm else None
    # Staged: files that are renamed can't be read again under their old names.
    docs = staged(api.process(spark, said.folder, ocr=pdf.recogniser(said.ocr) if said.ocr else None, name_pattern=said.pattern, model=model), "documents")
    documents.run_summary(docs).show(truncate=False)
    if said.plan or said.rename:
        plan = staged(api.renames(docs, reuse_freed=said.rename), "renames")
        if said.plan:
            plan.orderBy("file").show(1000, truncate=False)
        if said.rename:
            print(f"{api.apply_renames(plan, said.folder)} moves")
            docs = naming.apply_plan(docs, plan)
    if said.out and said.json:
        sinks.write_json_array(docs, said.out)
    elif said.out:
        sinks.write_csv(documents.article_rows(docs), said.out, header=R.CSV_HEADER_EN if said.english else R.CSV_HEADER, single=True)


if __name__ == "__main__":
    main()
