"""The plugins as a table function of SQL: ``SELECT p.* FROM files f, LATERAL parse_file(f.lang, f.path, f.text) p``."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from knotweave.extract.registry import SCHEMA, parsers, parsed_rows


@udtf(returnType=SCHEMA)
class ParseFile:
    """Rows of kind node, edge or error of one file; none for a null text or a language without a plugin."""

    def eval(self, lang: str, path: str, text: str) -> Iterator[tuple]:
        if text is not None and lang in parsers():
            yield from parsed_rows(lang, path, text)


def register(spark: SparkSession) -> None:
    spark.udtf.register("parse_file", ParseFile)
