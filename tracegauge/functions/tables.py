"""Table functions for SQL users."""

from __future__ import annotations

import heapq
import math
import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from tracegauge.functions.text import MIN_SECRET_ENTROPY, PLACEHOLDER, SECRET_ASSIGNMENT, SECRET_PATTERNS


def _plain(value: str) -> bool:
    """Placeholders and values of little entropy."""
    bits = sum(math.log2(len(value) / value.count(c)) for c in value) / len(value)
    return bool(re.match(PLACEHOLDER, value)) or bits < MIN_SECRET_ENTROPY


def _matches(rank: int, kind: str, pattern: str, group: int, text: str) -> Iterator[tuple[int, int, int, str]]:
    for m in re.finditer(pattern, text):
        if kind != "assigned_secret" or not _plain(m[group]):
            yield m.start(group), -m.end(group), rank, kind


_KINDS = [(k, p, 1 if k == "db_url_password" else 0) for k, p in SECRET_PATTERNS.items()] + [("assigned_secret", SECRET_ASSIGNMENT, 3)]


@udtf(returnType="kind STRING, start BIGINT, `end` BIGINT, line BIGINT")
class SecretSpans:
    """Spans of secrets in one text: ``SELECT d.id, s.* FROM docs d, LATERAL secret_spans(d.text) s``.

    Each kind's matches are a stream in order of position; the merged stream is read once. For whole
    tables prefer :func:`tracegauge.functions.text.find_secrets`, which stays in the JVM.
    """

    def eval(self, text: str):
        free = line_at = 0
        line = 1
        for start, neg_end, _, kind in heapq.merge(*(_matches(i, *k, text) for i, k in enumerate(_KINDS))) if text else ():
            if start >= free:
                line, line_at, free = line + text.count("\n", line_at, start), start, -neg_end
                yield kind, start, free, line


def register(spark: SparkSession) -> None:
    spark.udtf.register("secret_spans", SecretSpans)
