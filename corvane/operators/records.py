"""The record corpus: canonical columns, filters, lint and summaries."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

MANDATORY = ("id", "stack", "blast_radius", "source", "wrong", "correct", "symptom", "tags")
SEVERITIES = ("low", "medium", "high", "critical")
ENRICHMENT = ("title", "content", "summary", "example_triggers", "antipattern_category", "applies_when", "structural_pattern")


def knowledge_only(records: DataFrame) -> DataFrame:
    return records.filter(F.col("type").isNull() | (F.col("type") == "knowledge")) if "type" in records.columns else records


def with_overlay(records: DataFrame, personal: DataFrame) -> DataFrame:
    """The corpus and the personal records, which form a stack of their own."""
    return records.unionByName(personal.withColumn("stack", F.lit("_personal")), allowMissingColumns=True)


def injectable(tier: Column, status: Column, registered: Column, hosts: Column) -> Column:
    """Tier 2 needs a steward; disputed records never pass; tier 1 fails in a domain that is registered without hosts."""
    blocked = (F.coalesce(tier, F.lit(0)) == 2) & ~F.coalesce(status == "steward-verified", F.lit(False))
    blocked = blocked | F.coalesce(status == "disputed", F.lit(False))
    return ~(blocked | ((F.coalesce(tier, F.lit(0)) == 1) & registered & (F.coalesce(hosts, F.lit(0)) == 0)))


def in_profile(facet: Column, domain: Column, facets: Sequence[str], domains: Sequence[str]) -> Column:
    """An empty list lets everything pass."""
    f = F.coalesce(facet.isin(*facets), F.lit(False)) if facets else F.lit(True)
    d = F.coalesce(domain.isin(*domains), F.lit(False)) if domains else F.lit(True)
    return f & d


def structural_findings(columns: Sequence[str]) -> tuple[Column, Column]:
    """(errors, warnings) of a record, as arrays of messages; a null counts as missing."""
    c = F.col
    errors = [F.when(c(f).isNull(), F.lit(f"missing {f}")) for f in MANDATORY]
    errors.append(F.when(~c("id").rlike("^[a-z0-9_]+$"), F.lit("bad id")))
    errors += [F.when(F.length(F.trim(c(f))) < 20, F.lit(f"short {f}")) for f in ("wrong", "correct", "symptom")]
    errors.append(F.when(~c("blast_radius").isin(*SEVERITIES), F.lit("bad blast_radius")))
    if "confidence" in columns:
        errors.append(F.when((c("confidence") < 0) | (c("confidence") > 1), F.lit("bad confidence")))
    warnings = [F.when(F.size("tags") == 0, F.lit("no tags"))]
    if "doc_reference" in columns:
        warnings.append(F.when(c("doc_reference").isNull(), F.lit("no doc_reference")))
    return F.array_compact(F.array(*errors)), F.array_compact(F.array(*warnings))


def structural_lint(records: DataFrame) -> DataFrame:
    errors, warnings = structural_findings(records.columns)
    return records.withColumns({"errors": errors, "warnings": warnings}).withColumn("ok", F.size("errors") == 0)


# Fixed values: (rule, severity, pattern). The boundary is spelled out, as only ASCII letters, digits and _ are word characters.
_W = "(?<![A-Za-z0-9_])"
_E = "(?![A-Za-z0-9_])"
PRIVACY_RULES = (
    ("absolute_unix_path", "medium", r"/(?:Users|home)/[a-zA-Z0-9._-]+"),
    ("windows_user_path", "medium", r"C:\\Users\\[a-zA-Z0-9._-]+"),
    ("internal_hostname", "high", rf"(?i){_W}[a-zA-Z0-9-]+\.(?:internal|corp|local|lan){_E}"),
    ("private_ip", "high", rf"{_W}(?:10\.[0-9]{{1,3}}\.[0-9]{{1,3}}\.[0-9]{{1,3}}|192\.168\.[0-9]{{1,3}}\.[0-9]{{1,3}}|172\.(?:1[6-9]|2[0-9]|3[01])\.[0-9]{{1,3}}\.[0-9]{{1,3}}){_E}"),
    ("email_address", "high", rf"{_W}[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{{2,}}{_E}"),
    ("company_specific_domain_guess", "medium", rf"{_W}[A-Z][a-z]+[A-Z][a-zA-Z]*{_E}"),
    ("aws_style_secret", "high", rf"{_W}(?:AKIA|ASIA)[0-9A-Z]{{16}}{_E}"),
    ("generic_bearer_or_key", "high", rf"(?i){_W}(?:api[_-]?key|secret|token|bearer)\s*[:=]\s*['\"]?[A-Za-z0-9_\-]{{16,}}['\"]?"),
)
# Placeholders that aren't findings.
EXEMPT_EMAIL_DOMAINS = ("example.com", "example.org", "example.net", "example.edu", "test.com", "yourdomain.com")
EXEMPT_HOSTS = ("host.docker.internal", "env.local", ".env.local", "localhost.localdomain")
EXEMPT_LABELS = ("env", "path", "test", "tmp", "config", "settings", "local", "docker")


def _exempt(rule: str, found: Column) -> Column:
    low = F.lower(found)
    if rule == "email_address":
        local, domain = F.split_part(found, F.lit("@"), F.lit(1)), F.split_part(low, F.lit("@"), F.lit(2))
        return domain.isin(*EXEMPT_EMAIL_DOMAINS) | ((F.length(local) <= 2) & (F.length(F.split_part(domain, F.lit("."), F.lit(1))) <= 2))
    if rule == "internal_hostname":
        return low.isin(*EXEMPT_HOSTS) | low.endswith(".svc.cluster.local") | F.split_part(low, F.lit("."), F.lit(-2)).isin(*EXEMPT_LABELS)
    return F.lit(False)


def _kept(rule: str) -> Callable[[Column], Column]:
    return lambda m: ~_exempt(rule, m)


# A text without one of these can't match the rule; None: the rule is always tried. Those of rules that ignore case are looked for in the lower-cased text.
_NEEDED = {
    "absolute_unix_path": ("/Users/", "/home/"),
    "windows_user_path": ("C:\\Users\\",),
    "internal_hostname": (".internal", ".corp", ".local", ".lan"),
    "private_ip": ("10.", "192.168.", "172."),
    "email_address": ("@",),
    "company_specific_domain_guess": None,
    "aws_style_secret": ("AKIA", "ASIA"),
    "generic_bearer_or_key": ("key", "secret", "token", "bearer"),
}


def _matches(text: Column, rule: str, pattern: str) -> Column:
    """All matches that aren't exempt; a plain search for what the rule needs comes before the expression."""
    found = F.filter(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), _kept(rule))
    if not (needed := _NEEDED[rule]):
        return found
    plain, test = F.lower(text) if pattern.startswith("(?i)") else text, F.lit(False)
    for w in needed:
        test = test | F.contains(plain, F.lit(w))
    return F.when(test, found).otherwise(F.expr("cast(array() as array<string>)"))


def _rules(capture_form: bool) -> list[tuple[str, str, str]]:
    return [r for r in PRIVACY_RULES if not (capture_form and r[0] == "company_specific_domain_guess")]


def privacy_findings(records: DataFrame, fields: Sequence[str], key: str = "id", capture_form: bool = False, most: int = 3) -> DataFrame:
    """One row for each (record, field, rule) with matches: severity, number of matches, the first ``most`` of them.

    The capture form leaves the company-name guess out.
    """
    checks = []
    for field in fields:
        for rule, severity, pattern in _rules(capture_form):
            found = _matches(F.coalesce(F.col(field), F.lit("")), rule, pattern)
            checks.append(F.struct(F.lit(field).alias("field"), F.lit(rule).alias("rule_id"), F.lit(severity).alias("severity"), F.size(found).alias("n_matches"), F.slice(found, 1, most).alias("matches")))
    return records.select(key, F.explode(F.array(*checks)).alias("f")).select(key, "f.*").filter("n_matches > 0")


def _hits(fields: Sequence[str], capture_form: bool) -> Column:
    hits = [F.struct((F.lit(severity) == "high").alias("high"), (F.size(_matches(F.coalesce(F.col(f), F.lit("")), rule, pattern)) > 0).alias("found")) for f in fields for rule, severity, pattern in _rules(capture_form)]
    return F.filter(F.array(*hits), lambda x: x["found"])


def blocking(records: DataFrame, fields: Sequence[str], key: str = "id", capture_form: bool = False) -> DataFrame:
    """(key, blocking, findings) for every row: blocking if a finding is of high severity. Each row is judged by itself, without a shuffle."""
    d = records.select(key, _hits(fields, capture_form).alias("_f"))
    return d.select(key, F.exists("_f", lambda x: x["high"]).alias("blocking"), F.size("_f").cast("bigint").alias("findings"))


def with_blocking(records: DataFrame, fields: Sequence[str], capture_form: bool = False) -> DataFrame:
    """``records`` with ``blocking``: whether a row has a finding of high severity."""
    return records.withColumn("blocking", F.exists(_hits(fields, capture_form), lambda x: x["high"]))


def manifest(records: DataFrame) -> DataFrame:
    sets = lambda c: F.array_sort(F.collect_set(c))
    return records.agg(F.count(F.lit(1)).alias("seed_count"), sets("stack").alias("stacks"), sets("domain").alias("domains"))


def reputation(stats: DataFrame) -> DataFrame:
    """0 to 100 from seven stepped components, and a grade, on a one-row table of corpus statistics."""
    # The steps.
    c = F.col
    steps = lambda col, *rest: F.when(c(col) >= rest[0], rest[1]).when(c(col) >= rest[2], rest[3])
    score = (
        F.when(c("total_seeds") >= 200, 20).when(c("total_seeds") >= 50, 15).when(c("total_seeds") >= 10, 8).otherwise(F.floor(c("total_seeds") / 2))
        + steps("stacks_covered", 10, 15, 5, 10).otherwise(F.floor(c("stacks_covered") * 1.5))
        + steps("personal_seeds", 20, 15, 5, 10).otherwise(c("personal_seeds"))
        + F.when(c("total_seeds") > 0, F.floor(c("seeds_with_doc_ref") / c("total_seeds") * 20)).otherwise(0)
        + F.when(c("tracked_seeds") > 0, 5 + F.when(c("tracked_seeds") >= 10, 5).otherwise(0) + F.when(c("avg_confidence") > 0.75, 5).otherwise(0)).otherwise(0)
        + F.when(c("drift_stale").isNotNull(), F.greatest(F.lit(0), 10 - c("drift_stale") * 2)).otherwise(0)
        + F.floor(c("symptom_ratio") * 5)
    )
    d = stats.withColumn("reputation", F.least(F.lit(100), score).cast("bigint"))
    grade = F.when(c("reputation") >= 90, "S").when(c("reputation") >= 75, "A").when(c("reputation") >= 60, "B").when(c("reputation") >= 40, "C").otherwise("D")
    return d.withColumn("grade", grade)


def stale(records: DataFrame, stacks: DataFrame) -> DataFrame:
    """Records of volatile stacks with a known version that were never reviewed, or reviewed before the version was checked."""
    known = stacks.filter(F.coalesce("volatile", F.lit(False)) & F.col("version").isNotNull())
    return records.join(known, "stack").filter(F.col("reviewed_at").isNull() | (F.col("reviewed_at") < F.col("checked_at")))


def enriched(records: DataFrame) -> DataFrame:
    """Missing enrichment fields inferred; present values stay."""
    have = set(records.columns)
    old = lambda c: F.col(c) if c in have else F.lit(None).cast("string")
    title = F.coalesce(old("title"), F.initcap(F.regexp_replace("id", "_", " ")))
    d = records.withColumn("title", title)
    d = d.withColumn("content", F.coalesce(old("content"), F.concat(F.lit("WRONG: "), F.col("wrong"), F.lit(" CORRECT: "), F.col("correct"), F.lit(" Symptom: "), F.col("symptom"))))
    d = d.withColumn("antipattern_category", F.coalesce(old("antipattern_category"), T.category(F.concat_ws(" ", "content", F.array_join("tags", " ")))))
    return d.withColumn("summary", F.coalesce(old("summary"), F.concat(F.col("title"), F.lit(": "), F.substring(F.substring_index("symptom", ".", 1), 1, 100))))


def training_pairs(records: DataFrame, key: str = "id") -> DataFrame:
    """(key, kind, left, right): what a record says of itself in two ways, for models of similarity: symptom and wrong section, symptom and title (200 characters), tags and symptom.

    Records without a symptom give none, and a side that is null or empty gives no pair.
    """
    pair = lambda kind, a, b: F.struct(F.lit(kind).alias("kind"), a.alias("left"), b.alias("right"))
    symptom, title = F.col("symptom"), F.substring("title", 1, 200)
    pairs = F.array(pair("wrong", symptom, F.col("wrong")), pair("title", symptom, title), pair("tags", F.array_join("tags", " "), symptom))
    d = records.filter("symptom <> ''").select(key, F.explode(F.filter(pairs, lambda p: (p["left"] != "") & (p["right"] != ""))).alias("p"))
    return d.select(key, "p.*")


def reusable(current: DataFrame, built: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """(rows of ``built`` that still hold, rows of ``current`` to build): equal key, content hash and model."""
    on = [key, "hash", "model_id"]
    return built.join(current.select(*on), on, "left_semi"), current.join(built.select(*on), on, "left_anti")


def upserted(store: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """``new`` rows replace those with the same key."""
    return store.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def staged(store: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """The rows to append; raises if one of their keys is there already, before anything is written."""
    clash = new.join(store.select(key), key, "left_semi").unionByName(new.groupBy(key).count().filter("count > 1").join(new, key, "left_semi").select(key).join(new, key, "left_semi"), allowMissingColumns=True)
    taken = clash.select(key).limit(5).collect()
    if taken:
        raise ValueError(f"ids already staged: {', '.join(str(r[0]) for r in taken)}")
    return new
