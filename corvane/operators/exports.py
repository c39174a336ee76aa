"""Rendered exports: record pages, stack texts, the symptom index, site map."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def pages(records: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """(path, body): one markdown page per record, links only to exported ids; equal paths get a suffix in id order."""
    slug = T.kebab_slug(F.col("id"))
    n = F.row_number().over(Window.partitionBy("stack", "_slug").orderBy("id"))
    d = records.withColumn("_slug", slug).withColumn("path", F.concat("stack", F.lit("/"), F.col("_slug"), F.when(n > 1, F.concat(F.lit("-"), n.cast("string"))).otherwise(""), F.lit(".md")))
    if edges is not None:
        known = edges.join(records.select(F.col("id").alias("dst")), "dst", "left_semi")
        links = known.groupBy(F.col("src").alias("id")).agg(F.array_join(F.array_sort(F.collect_set(F.concat(F.lit("[["), T.kebab_slug(F.col("dst")), F.lit("]]")))), " ").alias("_links"))
        d = d.join(links, "id", "left")
    else:
        d = d.withColumn("_links", F.lit(None).cast("string"))
    clean = lambda c: F.regexp_replace(F.regexp_replace(c, r"(?m)^#+\s*", ""), r"(?m)^-{3,}\s*$", "")
    head = F.concat_ws("\n", F.lit("---"), F.concat(F.lit("id: "), F.to_json(F.struct("id"))), F.concat(F.lit("tags: ["), F.array_join("tags", ", "), F.lit("]")), F.lit("---"))
    body = F.concat_ws("\n\n", head, F.concat(F.lit("WRONG: "), clean("wrong")), F.concat(F.lit("CORRECT: "), clean("correct")), F.concat(F.lit("Symptom: "), clean("symptom")), "_links")
    return d.select("path", body.alias("body"))


def stack_texts(records: DataFrame) -> DataFrame:
    """(stack, value): the lines of each stack's text, deprecated records left out; write with ``partitionBy('stack').text``."""
    d = records.filter(~F.coalesce("deprecated", F.lit(False)))
    return d.select("stack", F.concat_ws(" | ", "id", F.concat(F.lit("WRONG: "), "wrong"), F.concat(F.lit("CORRECT: "), "correct"), F.concat(F.lit("Symptom: "), "symptom")).alias("value"))


def symptom_index(records: DataFrame, injectable=None) -> DataFrame:
    """(token, stack, id, symptom): the long form of the postings."""
    d = records.filter("symptom is not null and symptom <> ''")
    d = d if injectable is None else d.filter(injectable)
    words = F.array_distinct(F.concat(T.tokens(F.col("symptom"), T.STOP_INDEX, "_"), F.coalesce("tags", F.expr("cast(array() as array<string>)"))))
    return d.select(F.explode(words).alias("token"), "stack", "id", F.substring("symptom", 1, 200).alias("symptom"))


def rewritten(texts: DataFrame, column: str, phrases: dict[str, str], words: dict[str, str]) -> DataFrame:
    """Phrase and whole-word replacements, in order."""
    out = F.col(column)
    for old, new in phrases.items():
        out = F.replace(out, F.lit(old), F.lit(new))
    for old, new in words.items():
        out = F.regexp_replace(out, rf"(?<![A-Za-z0-9_])\Q{old}\E(?![A-Za-z0-9_])", new)
    return texts.withColumn(column, out)


def occurrences(texts: DataFrame, key: str, column: str, pattern: str) -> DataFrame:
    """(key, line, text) of lines that match, counted from 1."""
    return texts.select(key, F.posexplode(F.split(column, "\n")).alias("_n", "text")).filter(F.col("text").rlike(pattern)).select(key, (F.col("_n") + 1).alias("line"), "text")


# The marks of the categories.
MARKS = {"security": "🔒", "data-loss": "💾", "concurrency": "⚡", "performance": "🐢", "correctness": "✓", "readability": "📖"}
# When a category's records are to be used.
ADVICE = {
    "security": "Always inject relevant security seeds even at low match confidence.",
    "data-loss": "Always check — these antipatterns have irreversible consequences.",
    "concurrency": "Check when working with async code, goroutines, threads, or queues.",
    "performance": "Check when performance is the explicit topic.",
    "correctness": "Inject when the pattern clearly matches the described problem.",
    "readability": "Mention when context allows and the problem is explicitly about code quality.",
}
#: What orders the lines of exported files: part of the file, place in the part, stack, record.
LINE_ORDER = ("part", "place", "stack", "id")


def category_lines(records: DataFrame, category: Column, title: str = "Records") -> DataFrame:
    """(path, part, place, stack, id, body): the texts of ``index.md``, ``seeds.md`` and ``seeds-<category>.md``, one row for a heading or a record.

    ``records`` has id, stack, blast_radius, summary, wrong, correct, symptom, example_triggers (array); nulls are left out of the texts, an unknown category is
    ``correctness``, and records without an id are left out. Pass publishable records; write with ``files.write_files(..., order=LINE_ORDER)``. Only the number of records of each category is counted; nothing is grouped.
    """
    c = F.when(category.isin(*MARKS), category).otherwise("correctness")
    d = records.filter("id is not null").withColumns({"_c": c, "stack": F.coalesce("stack", F.lit("universal"))})
    names = F.array(*[F.lit(x) for x in MARKS])
    part = F.array_position(names, F.col("_c")).cast("int")
    mark = F.element_at(F.create_map(*[F.lit(x) for kv in MARKS.items() for x in kv]), F.col("_c"))
    advice = F.element_at(F.create_map(*[F.lit(x) for kv in ADVICE.items() for x in kv]), F.col("_c"))
    short = lambda x, most: T.brief(F.coalesce(x, F.lit("")), most)
    triggers = F.coalesce("example_triggers", F.array().cast("array<string>"))
    first, second = short(F.coalesce(F.get(triggers, F.lit(0)), "symptom"), 90), short(F.get(triggers, F.lit(1)), 90)
    line = lambda name, x: F.when(x != "", F.concat(F.lit(name), x))
    shown = F.concat_ws(
        "\n",
        F.concat(F.lit("**"), "id", F.lit("** ["), "stack", F.when(F.col("blast_radius") == "high", "·⚡").otherwise(""), F.lit("]")),
        short(F.col("summary"), 110),
        F.when(first != "", F.concat(F.lit('T: "'), first, F.lit('"'), F.when(second != "", F.concat(F.lit('  "'), second, F.lit('"'))).otherwise(""))),
        line("W: ", short(F.col("wrong"), 100)),
        line("C: ", short(F.col("correct"), 100)),
        F.lit(""),
    )
    listed = F.concat(F.col("id"), F.lit(" ["), "stack", F.lit("] "), short(F.col("summary"), 70))
    row = lambda path, part, place, stack, body: F.struct(path.alias("path"), part.alias("part"), F.lit(place).alias("place"), stack.alias("stack"), body.alias("body"))
    none, whole = F.lit(""), F.concat(F.lit("seeds-"), "_c", F.lit(".md"))
    of_record = F.array(row(F.lit("index.md"), part, 1, F.col("stack"), listed), row(F.lit("seeds.md"), part, 1, none, shown), row(whole, part, 1, none, shown))
    n = F.col("_n").cast("string")
    upper = F.upper("_c")
    of_category = F.array(
        row(F.lit("index.md"), part, 0, none, F.concat(F.lit("## "), mark, F.lit(" "), upper, F.lit(" ("), n, F.lit(")"))),
        row(F.lit("index.md"), part, 2, none, none),
        row(F.lit("seeds.md"), part, 0, none, F.concat(F.lit("---\n# "), mark, F.lit(" "), upper, F.lit(" — "), n, F.lit(" seeds\n"))),
        row(whole, part, 0, none, F.concat(F.lit(f"# {title} — "), mark, F.lit(" "), upper, F.lit("\n\n"), n, F.lit(" seeds in this category. "), advice, F.lit("\n"))),
    )
    heads = [("index.md", f"# {title}: index\n\nOne line per seed. Format: `id [stack|category] summary`\n"), ("seeds.md", f"# {title}: full reference\n\nSeeds by category; T: triggers, W: wrong, C: correct.\n")]
    top = records.sparkSession.createDataFrame([(path, 0, 0, "", "", body) for path, body in heads], "path string, part int, place int, stack string, id string, body string")
    counts = d.groupBy("_c").agg(F.count(F.lit(1)).alias("_n")).select(F.explode(of_category).alias("r")).select("r.path", "r.part", "r.place", "r.stack", F.lit("").alias("id"), "r.body")
    return top.unionByName(counts).unionByName(d.select("id", F.explode(of_record).alias("r")).select("r.path", "r.part", "r.place", "r.stack", "id", "r.body"))


def vocabulary(records: DataFrame, few: int = 2, many: int = 15) -> DataFrame:
    """(item, place, ids): tokens of symptoms, triggers and wrong sections that ``few`` to ``many`` records have; those of the fewest come first, then in order of appearance by id."""
    text = F.concat_ws(" ", F.coalesce("symptom", F.lit("")), F.array_join(F.coalesce("example_triggers", F.array().cast("array<string>")), " "), F.coalesce("wrong", F.lit("")))
    d = records.filter("id is not null").select("id", F.posexplode(T.tokens(text, T.STOP_PROJECT)).alias("pos", "item")).groupBy("item", "id").agg(F.min("pos").alias("pos"))
    often = d.groupBy("item").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n").between(few, many)).select("item")  # so no token's list grows beyond ``many``
    ids = d.join(often, "item").groupBy("item").agg(F.array_sort(F.collect_list(F.struct("id", "pos"))).alias("x"))
    return ids.select("item", F.struct(F.size("x").alias("n"), F.col("x")[0]["id"].alias("id"), F.col("x")[0]["pos"].alias("pos"), "item").alias("place"), F.transform("x", lambda r: r["id"]).alias("ids"))


def symptom_map(vocabulary: DataFrame, clusters: DataFrame, most: int = 300, shown: int = 6, title: str = "Records") -> DataFrame:
    """(path, part, place, stack, id, body) of ``symptom-map.md``: the ``most`` smallest clusters of tokens and the records that their leaders name."""
    d = clusters.join(vocabulary.select("item", "place"), "item").groupBy("leader").agg(F.array_sort(F.collect_list(F.struct("place", "item"))).alias("t"))
    d = d.join(vocabulary.select(F.col("item").alias("leader"), "place", "ids"), "leader").orderBy("place").limit(most)
    words = F.array_join(F.transform(F.slice("t", 1, shown), lambda r: F.concat(F.lit('"'), r["item"], F.lit('"'))), " · ")
    more = F.when(F.size("ids") > shown, F.concat(F.lit(" (+"), (F.size("ids") - shown).cast("string"), F.lit(" more)"))).otherwise("")
    body = F.concat(F.lit("**"), words, F.lit("**\n→ "), F.array_join(F.slice("ids", 1, shown), ", "), more, F.lit("\n"))
    n = F.row_number().over(Window.orderBy("place"))  # of the few that are shown
    rows = d.select(F.lit("symptom-map.md").alias("path"), F.lit(1).alias("part"), n.alias("place"), F.lit("").alias("stack"), F.lit("").alias("id"), body.alias("body"))
    top = d.sparkSession.createDataFrame([("symptom-map.md", 0, 0, "", "", f"# {title}: symptom vocabulary\n\nMaps problem vocabulary to seed ids.\n")], "path string, part int, place int, stack string, id string, body string")
    return top.unionByName(rows)
