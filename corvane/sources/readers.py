"""Readers of record libraries, session archives, text directories and federated jars."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T

EDGES = "map<string,array<struct<id:string,confidence:double,log_weight:double,source:string,position:int>>>"
RECORD = f"""id string, stack string, blast_radius string, source string, wrong string, correct string, symptom string, tags array<string>, domain string, facet string,
confidence double, doc_reference string, title string, content string, summary string, antipattern_category string, framework_version string, deprecated boolean,
reviewed_at timestamp, captured_at timestamp, domain_tier int, verification_status string, type string, project string, provenance string, relationships {EDGES}, _corrupt_record string"""
SESSION = """session_id string, generated_at string, recorded_at timestamp, outcome string, query string, query_stack string, injected array<string>, injected_ids array<string>,
cited_seed_ids array<string>, contradicted_seed_ids array<string>, initial_query_embedding array<double>"""


def read_records(spark: SparkSession, root: str, include_personal: bool = False) -> DataFrame:
    """All records under ``root``/seeds: the stack comes from the file name, unparsable files give nothing, missing texts are cut from the content, a missing source means the community."""
    d = spark.read.schema(RECORD).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(f"{root}/seeds").withColumn("_path", F.input_file_name())
    d = d.filter(F.col("id").isNotNull())  # files that can't be parsed give rows of nulls
    if not include_personal:
        d = d.filter(~F.contains("_path", F.lit("/personal/")))
    part = lambda name, marker: F.coalesce(F.col(name), F.nullif(T.section(F.col("content"), marker), F.lit("")))
    return d.withColumns({"stack": F.regexp_extract("_path", r"([^/]+)\.json$", 1), "wrong": part("wrong", "WRONG"), "correct": part("correct", "CORRECT"), "symptom": part("symptom", "Symptom"), "source": F.coalesce("source", F.lit("community"))}).drop("_path", "_corrupt_record")


def corrupt_files(spark: SparkSession, root: str) -> DataFrame:
    """(path) of the files that aren't JSON."""
    d = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(f"{root}/seeds", wholetext=True)
    return d.select(F.input_file_name().alias("path"), F.try_parse_json("value").isNull().alias("corrupt")).filter("corrupt").select("path")


def edge_id(item: Column) -> Column:
    """The id of an edge or injected item that is a bare string or an object."""
    return F.coalesce(F.get_json_object(item, "$.id"), item)


def read_sessions(spark: SparkSession, path: str, last: DataFrame | None = None) -> DataFrame:
    """Sessions with a list of injected items, as ids; the last session is added unless it is archived already."""
    d = spark.read.schema(SESSION).option("multiLine", True).json(path)
    if last is not None:
        own = lambda x: F.coalesce(x["session_id"], x["generated_at"])
        d = d.unionByName(last.join(d.select(own(d).alias("_id")), own(last) == F.col("_id"), "left_anti"), allowMissingColumns=True)
    d = d.withColumn("injected", F.transform(F.coalesce("injected", "injected_ids"), edge_id)).filter(F.col("injected").isNotNull())
    return d.withColumn("session_id", F.coalesce("session_id", "generated_at")).drop("injected_ids", "generated_at")


def in_order(sessions: DataFrame) -> DataFrame:
    """Sessions by ``recorded_at``, those without it first, ties by id; a total order, for results that are shown."""
    return sessions.orderBy("recorded_at", "session_id")


def read_text_directory(spark: SparkSession, path: str, glob: str = "*.{md,txt}") -> DataFrame:
    """(path, name, text) of all matching files."""
    d = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(path, wholetext=True)
    return d.select(F.input_file_name().alias("path"), F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1).alias("name"), F.col("value").alias("text"))


def chunk_texts(files: DataFrame, most: int = 1400, overlap: int = 200) -> DataFrame:
    """(path, index, heading, text, embedding_text, hash): sections at headings, paragraphs packed to ``most`` characters with a carry of ``overlap``."""
    parts = files.select("path", "name", F.posexplode(F.split("text", r"(?m)^(?=#{1,3}\s)")).alias("section", "body"))
    head = F.regexp_extract("body", r"^#{1,3}\s+([^\n]{1,119})", 1)
    rest = F.regexp_replace("body", r"^#{1,3}\s+[^\n]*\n?", "")
    paragraphs = F.filter(F.transform(F.split(rest, r"\n\s*\n"), lambda p: F.trim(p)), lambda p: F.length(p) > 20)
    step = lambda s, p: (
        F.when((F.length(s["open"]) > 0) & (F.length(s["open"]) + F.length(p) + 2 > most), F.struct(F.concat(s["done"], F.array(s["open"])).alias("done"), F.concat(F.right(s["open"], F.lit(overlap)), F.lit("\n\n"), p).alias("open")))
        .otherwise(F.struct(s["done"].alias("done"), F.when(F.length(s["open"]) > 0, F.concat(s["open"], F.lit("\n\n"), p)).otherwise(p).alias("open")))
    )
    start = F.struct(F.expr("cast(array() as array<string>)").alias("done"), F.lit("").alias("open"))
    packed = F.aggregate(paragraphs, start, step, lambda s: F.when(F.length(s["open"]) > 0, F.concat(s["done"], F.array(s["open"]))).otherwise(s["done"]))
    d = parts.select("path", "name", "section", head.alias("heading"), F.posexplode(packed).alias("part", "text"))
    d = d.withColumn("embedding_text", T.contextual_prefix(F.col("name"), F.col("heading"), F.col("text")))
    return d.select("path", "section", F.col("part").alias("index"), "heading", "text", "embedding_text", T.content_hash(F.col("text")).alias("hash"))


def read_jars(spark: SparkSession, root: str, version: int) -> DataFrame:
    """Records of federated libraries at ``root``/{owner}__{repo}/seeds whose manifest has the current or the previous version and all required fields."""
    m = spark.read.schema("schema_version string, jar_name string, seed_count long, stacks array<string>, last_updated string").option("multiLine", True).json(f"{root}/*/*manifest*.json")
    m = m.withColumn("jar", F.regexp_extract(F.input_file_name(), r"([^/]+__[^/]+)/[^/]+$", 1))
    whole = F.col("jar_name").isNotNull() & F.col("stacks").isNotNull() & F.col("last_updated").isNotNull() & (F.col("seed_count") >= 0)
    m = m.filter(whole & T.compatible_version(F.col("schema_version"), version)).select("jar")
    d = spark.read.schema(RECORD).option("multiLine", True).json(f"{root}/*/seeds/*.json").withColumn("_path", F.input_file_name())
    d = d.withColumns({"jar": F.regexp_extract("_path", r"([^/]+__[^/]+)/seeds/", 1), "stack": F.regexp_extract("_path", r"([^/]+)\.json$", 1)})
    return d.filter(F.col("id").isNotNull()).join(m, "jar").drop("_path", "_corrupt_record").withColumn("jar", F.replace("jar", F.lit("__"), F.lit("/")))


def read_stack(spark: SparkSession, root: str, stack: str) -> DataFrame | None:
    """The records of one stack; None if it has no file, or none that can be parsed."""
    try:
        d = spark.read.schema(RECORD).option("multiLine", True).json(f"{root}/seeds/{stack}.json")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    d = d.filter(F.col("id").isNotNull()).drop("_corrupt_record").withColumn("stack", F.lit(stack))
    return None if d.isEmpty() else d


def stack_listing(records: DataFrame, key: str = "id", most: int = 5) -> DataFrame:
    """(stack, records, tags): how many records each stack has, and its first distinct tags by record and place."""
    t = records.select("stack", key, F.posexplode("tags").alias("_p", "_tag")).groupBy("stack", "_tag").agg(F.min(F.struct(key, "_p")).alias("_at"))
    t = t.withColumn("_k", F.row_number().over(Window.partitionBy("stack").orderBy("_at"))).filter(F.col("_k") <= most)
    t = t.groupBy("stack").agg(F.transform(F.sort_array(F.collect_list(F.struct("_k", "_tag"))), lambda x: x["_tag"]).alias("tags"))
    n = records.groupBy("stack").agg(F.count(F.lit(1)).alias("records"))
    return n.join(t, "stack", "left").withColumn("tags", F.coalesce("tags", F.expr("cast(array() as array<string>)")))


def _entries(spark: SparkSession, path: str, kind: str, field: str | None = None) -> DataFrame:
    """(name, value) of the JSON object in a file, or of its ``field``; names that begin with an underscore are remarks. A value of another kind is null; a file that isn't there, or is no object, has none."""
    try:
        d = spark.read.text(path, wholetext=True)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], f"name string, value {kind}")
    whole = F.col("value") if field is None else F.get_json_object("value", f"$.{field}")
    raw = F.map_entries(F.from_json(F.when(F.try_parse_json(whole).isNotNull() & F.ltrim(whole).startswith("{"), whole), "map<string,string>"))
    value = F.col("e.value") if kind == "string" else F.from_json("e.value", kind)
    return d.select(F.explode(raw).alias("e")).filter(~F.col("e.key").startswith("_")).select(F.col("e.key").alias("name"), value.alias("value"))


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    """(name, label, active_facets, active_domains) of the profiles in a file; a list that is missing is empty and lets everything pass (``records.in_profile``)."""
    d = _entries(spark, path, "struct<label:string,active_facets:array<string>,active_domains:array<string>>")
    none = F.expr("cast(array() as array<string>)")
    return d.filter("value is not null").select("name", F.coalesce("value.label", "name").alias("label"), F.coalesce("value.active_facets", none).alias("active_facets"), F.coalesce("value.active_domains", none).alias("active_domains"))


def read_allowed_hosts(spark: SparkSession, path: str) -> DataFrame:
    """(domain, hosts) of a file that lists each domain's trusted hosts; a domain without any has 0, which ``records.injectable`` tells from one that isn't registered."""
    d = _entries(spark, path, "array<string>", "domains")
    return d.select(F.col("name").alias("domain"), F.coalesce("value", F.expr("cast(array() as array<string>)")).alias("hosts"))


def read_stack_versions(spark: SparkSession, config: str, versions: str) -> DataFrame:
    """(stack, volatile, version, checked_at) of the stacks in a file of settings, with the versions that another file knows, as ``records.stale`` takes them."""
    c = _entries(spark, config, "struct<volatile:boolean>").select(F.col("name").alias("stack"), F.coalesce("value.volatile", F.lit(False)).alias("volatile"))
    v = _entries(spark, versions, "string")
    field = lambda x: F.get_json_object("value", f"$.{x}")
    v = v.select(F.col("name").alias("stack"), F.coalesce(field("version"), F.when(~F.col("value").startswith("{"), F.col("value"))).alias("version"), field("checked_at").cast("timestamp").alias("checked_at"))
    return c.join(v, "stack", "left")


def read_wanted_maintainers(spark: SparkSession, path: str) -> DataFrame:
    """(stack, note) of the stacks that look for a maintainer."""
    d = spark.read.schema("stacks array<struct<stack:string,note:string>>").option("multiLine", True).json(path)
    return d.select(F.explode("stacks").alias("s")).select("s.*").filter("stack is not null")


def jar_skips(spark: SparkSession, root: str, version: int) -> DataFrame:
    """(jar, skip): why each federated library under ``root``/{owner}__{repo} is left out, or null if it is read: no JSON, a field that is missing or wrong, or another version."""
    m = spark.read.option("wholetext", True).text(f"{root}/*/*manifest*.json").select(F.regexp_extract(F.input_file_name(), r"([^/]+__[^/]+)/[^/]+$", 1).alias("_jar"), F.col("value").alias("_v"))
    field = lambda name: F.get_json_object("_v", f"$.{name}")
    names = ("schema_version", "jar_name", "seed_count", "stacks", "last_updated")
    missing = F.concat_ws("; ", *[F.when(field(n).isNull(), f"{n} is missing") for n in names], F.when(~F.coalesce(field("seed_count").try_cast("long") >= 0, F.lit(True)), "seed_count is negative"), F.when(~field("stacks").startswith("["), "stacks is no list"))
    skip = F.when(F.try_parse_json("_v").isNull(), "no JSON").when(missing != "", F.concat(F.lit("malformed manifest: "), missing)).when(~F.coalesce(T.compatible_version(field("schema_version"), version), F.lit(False)), F.concat(F.lit("incompatible schema_version "), field("schema_version")))
    return m.select(F.replace("_jar", F.lit("__"), F.lit("/")).alias("jar"), skip.alias("skip"))
