"""Answers of HTTP retrieval endpoints, parsed as a JSON string column; the transport is the caller's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scores import normalised_score

# Where answers keep their results, and what results call text and score.
LISTS = ("results", "documents", "chunks", "hits", "data", "matches")
TEXTS = ("text", "content", "_source.text", "page_content", "body")
SCORES = ("score", "relevance", "_score", "similarity")


def dig(json: Column, path: str) -> Column:
    """The value at a dotted path with [i] indices, as a string; null if it isn't there."""
    return F.get_json_object(json, f"$.{path}")


def parse_results(answers: DataFrame, key: str, json: str = "json", list_path: str | None = None, text_path: str | None = None, score_path: str | None = None) -> DataFrame:
    """(key, ordinal, text, score): one row per result, the layout being found by trying the known ones in order; scores on 0 to 1."""
    raw = F.col(json)
    paths = [list_path] if list_path else LISTS
    items = F.coalesce(*[dig(raw, p) for p in paths], F.when(F.trim(raw).startswith("["), raw))
    d = answers.select(key, F.posexplode(F.from_json(items, "array<string>")).alias("ordinal", "item"))
    text = F.coalesce(*[dig(F.col("item"), p) for p in ([text_path] if text_path else TEXTS)])
    score = F.coalesce(*[dig(F.col("item"), p) for p in ([score_path] if score_path else SCORES)]).cast("double")
    return d.select(key, "ordinal", text.alias("text"), normalised_score(score).alias("score")).filter("text is not null")


def request_body(template: str, query: Column, top_k: int) -> Column:
    """The JSON body of a request: ``{{query}}`` becomes the escaped text of the query, ``{{top_k}}`` the number of results. A null query counts as empty."""
    escaped = F.regexp_extract(F.to_json(F.struct(F.coalesce(query, F.lit("")).alias("q"))), r'(?s)^\{"q":"(.*)"\}$', 1)
    return F.replace(F.replace(F.lit(template), F.lit("{{top_k}}"), F.lit(str(top_k))), F.lit("{{query}}"), escaped)
