"""A job: score gold corpora and write the report. `python -m veilworks OUT CORPUS... [--real CORPUS...] [--key-file PATH]`

Exit codes: 0, 1 for any leak, 2 for an empty corpus, 3 for wrong usage. Missed targets are warnings.
"""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from veilworks.functions.crypto import checked_key
from veilworks.operators import scoring
from veilworks.plans.evaluate import EXIT_EMPTY, EXIT_USAGE, evaluate
from veilworks.sources import corpora


def main(args: list[str], spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="veilworks", exit_on_error=False)
    parser.add_argument("out")
    parser.add_argument("corpus", nargs="+")
    parser.add_argument("--real", nargs="*", default=[])
    parser.add_argument("--key-file", help="holds 32 bytes in base64; a new key if not given")
    try:
        given = parser.parse_args(args)
    except (argparse.ArgumentError, SystemExit) as e:
        if isinstance(e, SystemExit) and not e.code:  # help
            return 0
        print(e, file=sys.stderr)
        return EXIT_USAGE
    spark = spark or SparkSession.builder.appName("veilworks").getOrCreate()
    docs = corpora.read_gold(spark, *given.corpus)
    if given.real:
        docs = docs.unionByName(corpora.read_gold(spark, *given.real, source="real"))
    run = evaluate(docs, checked_key(Path(given.key_file).read_text().strip()) if given.key_file else None)
    for row in scoring.target_warnings(run.stats).collect():  # three at most
        print(f"warning: {row.warning}", file=sys.stderr)
    code = run.exit_code()
    if code != EXIT_EMPTY:
        run.write(given.out)
    return code


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
