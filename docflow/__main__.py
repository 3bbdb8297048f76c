"""Command line: python -m docflow --file PATH | --batch FOLDER [--output FOLDER] | --version [-v]"""

from __future__ import annotations

import argparse
import sys

from docflow import __version__


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="docflow", description="Parse documents into sections.")
    what = parser.add_mutually_exclusive_group(required=True)
    what.add_argument("--file", help="one file: its document and sections as JSON")
    what.add_argument("--batch", help="a folder: results and a summary of all files below it")
    what.add_argument("--version", action="version", version=__version__)
    parser.add_argument("--output", help="a folder for the JSON results; without it they are printed")
    parser.add_argument("-v", "--verbose", action="store_true", help="Spark's own messages, too")
    given = parser.parse_args(args)

    from docflow.operators import jobs
    from docflow.session import local_session
    from docflow.sources import ingest

    spark = local_session()
    if given.verbose:
        spark.sparkContext.setLogLevel("INFO")
    if given.batch:
        found, summary = jobs.batch(ingest.read_files(spark, given.batch), given.output)
        one = summary.first()
        print(summary.toJSON().first() if one else "{}")
        return int(one.failed_files > 0)
    folder, _, name = given.file.rpartition("/")
    inputs = ingest.read_files(spark, folder or ".", glob=name, recursive=False)
    documents, sections = jobs.process(inputs)
    texts = jobs.document_json(documents, sections)
    if given.output:
        texts.select("json").write.mode("overwrite").text(given.output)
    else:
        for row in texts.toLocalIterator():
            print(row.json)
    failed = jobs.results(documents, sections).filter("status = 'failed'").count()
    return int(failed > 0 or inputs.isEmpty())


if __name__ == "__main__":
    sys.exit(main())
