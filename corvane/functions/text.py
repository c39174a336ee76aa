"""Text expressions: tokenisers, sections, slugs, trimming, hashing. All are plain column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Stop words of the tokeniser variants.
STOP_BASE = """the and for not with this that from are was but all can its has have when been does did will would could should than then into over
after out due per via any each even also may use used set just let""".split()
STOP_INDEX = """the and for not with this that from are was but all can its has have when been does did will would could should than then into
over after out due per via any each even also may more being between both either else here how just let like most name new now our own same see
set such use used very want way which who why yet you your""".split()
STOP_MULTI = [*STOP_BASE, "you", "your"]
STOP_ATTRIBUTION = [*STOP_MULTI, *"must need make makes made using ensure always never avoid instead returns return call calls called".split()]
STOP_RELATIONS = [*STOP_BASE, "very", "more"]
STOP_CLUSTER = """the and for not with this that from are was but all can its has have when been does did will would should use used set let any
may also even over""".split()
STOP_COMPACT = "the and for not with this that from are was but all can its has have when been does did will use used set".split()
STOP_PROJECT = """the and for not with this that from are was but all can its has have when been does did will would could should than then into
also may use used set let you your my just per via any each even over out""".split()
STOP_KEYWORDS = "when then that this from with into".split()


def tokens(text: Column, stop: Sequence[str] = STOP_BASE, keep: str = "", longer_than: int = 2) -> Column:
    """Lower-cased runs of ``[a-z0-9]`` (and ``keep``) longer than ``longer_than`` that aren't stop words, in order, with repeats; null text gives none."""
    runs = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(rf"[a-z0-9{keep}]{{{longer_than + 1},}}"), F.lit(0))
    return F.filter(runs, lambda t: ~t.isin(*stop)) if stop else runs


def distinct_tokens(text: Column, stop: Sequence[str] = STOP_BASE) -> Column:
    return F.array_distinct(tokens(text, stop))


def first_tokens(text: Column, most: int, stop: Sequence[str] = STOP_BASE, prefix: int = 400) -> Column:
    """The first ``most`` distinct tokens. Where the first ``prefix`` characters, without a run that may go on behind them, have as many, the rest isn't tokenised."""
    head = distinct_tokens(F.regexp_replace(F.lower(F.substring(text, 1, prefix)), "[a-z0-9]+$", ""), stop)
    return F.when(F.size(head) >= most, F.slice(head, 1, most)).otherwise(F.slice(distinct_tokens(text, stop), 1, most))


def stability_tokens(text: Column) -> Column:
    """Without stop words, three characters or more, first occurrences in order."""
    return F.array_distinct(tokens(text, ()))


def keywords(text: Column) -> Column:
    """The first three words of more than three characters, joined by a middle dot."""
    return F.array_join(F.slice(tokens(text, STOP_KEYWORDS, longer_than=3), 1, 3), " · ")


def intent_share(text: Column, intent: str) -> Column:
    """The share of the words of ``intent`` that ``text`` contains, to three places."""
    words = intent.lower().split(" ")
    hits = sum((F.contains(F.lower(text), F.lit(w)).cast("int") for w in words), F.lit(0))
    return round_to(hits / len(words), 3)


def round_to(x: Column, places: int) -> Column:
    """Half up, towards plus infinity."""
    return F.floor(x * F.lit(float(10**places)) + 0.5) / F.lit(float(10**places))


def section(content: Column, marker: str, stops: Sequence[str] = ("WRONG:", "CORRECT:", "Symptom:"), most: int | None = None) -> Column:
    """The text after ``marker`` up to the next of ``stops``, trimmed, at most ``most`` characters."""
    found = F.trim(F.regexp_extract(content, rf"(?is){marker}:\s*(.*?)(?={'|'.join(stops)}|$)", 1))
    return F.substring(found, 1, most) if most else found


def first_sentence_of_symptom(content: Column) -> Column:
    found = F.regexp_extract(content, r"(?i)Symptom:\s*(.+?)(?:\.\s|$)", 1)
    return F.when(found != "", found)


def symptom_or_content(symptom: Column, content: Column) -> Column:
    return F.coalesce(symptom, F.trim(F.get(F.split(content, "Symptom:"), F.lit(1))))


def embedding_text(symptom: Column, wrong: Column, tags: Column, most: int = 2048) -> Column:
    """What is embedded: symptom, wrong approach and tags, never the correction."""
    return F.substring(F.trim(F.concat_ws(" ", symptom, wrong, F.array_join(tags, " "))), 1, most)


def snake_slug(text: Column, most: int = 80) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "_"), r"^_+|_+$", ""), 1, most)


def kebab_slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def derived_id(given: Column, *texts: Column, words: int = 8) -> Column:
    """The given id, else the first words of the slug of the first text there is."""
    slug = snake_slug(F.coalesce(*texts, F.lit("untitled")))
    return F.coalesce(given, F.array_join(F.slice(F.filter(F.split(slug, "_"), lambda x: x != ""), 1, words), "_"))


def brief(text: Column, most: int) -> Column:
    """White space collapsed; longer texts end with an ellipsis at ``most`` characters."""
    one = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.when(F.length(one) > most, F.concat(F.substring(one, 1, most - 1), F.lit("…"))).otherwise(one)


def sentences(text: Column, longer_than: int = 20) -> Column:
    parts = F.transform(F.split(text, r"(?<=[.!?])\s+(?=[A-Z])|\n(?=[A-Z])"), lambda s: F.trim(s))
    return F.filter(parts, lambda s: F.length(s) > longer_than)


def content_hash(text: Column, digits: int = 16) -> Column:
    return F.substring(F.sha2(text, 256), 1, digits)


def contextual_prefix(name: Column, heading: Column, chunk: Column) -> Column:
    head = F.concat_ws(" › ", F.regexp_replace(F.regexp_replace(name, r"\.[^.]+$", ""), "[-_]", " "), F.when(heading != "", heading))
    return F.concat(head, F.lit("\n\n"), chunk)


def token_estimate(text: Column) -> Column:
    return F.ceil(F.length(text) / 4)


def strip_tags(html: Column) -> Column:
    """The visible text of a page."""
    bare = F.regexp_replace(html, r"(?is)<(script|style|head)\b.*?</\1>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"<[^>]*>", " "), r"\s+", " "))


def category(text: Column) -> Column:
    """The first matching rule's category; rules match whole words only."""
    # Rules in order.
    rules = (
        ("security", r"security|xss|csrf|inject|sanitiz|escape|vuln|attack|exploit|password|token|auth(?:enticat|oriz)"),
        ("data-loss", r"data.?loss|corrupt|overwrite|irrecoverab|permanent.?delet|wipe"),
        ("concurrency", r"race.?condition|deadlock|concurren|mutex|atomic|goroutine|thread|lock|semaphore"),
        ("performance", r"performance|memory.?leak|slow|latency|timeout|cache|optim|efficienc"),
        ("readability", r"readab|format|naming|style|convention|maintainab"),
    )
    low, found = F.lower(text), F.lit("correctness")
    for name, words in reversed(rules):
        found = F.when(low.rlike(rf"(?<![A-Za-z0-9_])(?:{words})(?![A-Za-z0-9_])"), name).otherwise(found)
    return found


def version_tracked(version: Column, minor: bool) -> Column:
    return F.concat_ws(".", F.split_part(version, F.lit("."), F.lit(1)), F.split_part(version, F.lit("."), F.lit(2))) if minor else F.split_part(version, F.lit("."), F.lit(1))


def compatible_version(version: Column, current: int) -> Column:
    n = version.try_cast("int")
    return F.coalesce(n.isin(current, current - 1), F.lit(False))


def generic_url(url: Column) -> Column:
    # Endings of pages that are too general to cite.
    return url.rlike(r"/docs/?$|/guide/?$|/reference/?$|/manual/?$|/getting-started/?$|/introduction/?$|/overview/?$|wikipedia\.org/wiki/Mathematics$")


def safe_source_id(source_id: Column) -> Column:
    return F.coalesce(source_id.rlike("^[a-zA-Z0-9_-]{1,64}$"), F.lit(False))


def url_host(url: Column) -> Column:
    """The host in lower case; one in brackets (IPv6) keeps them."""
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]*)", 1))


def safe_url(url: Column) -> Column:
    """http or https, and no loopback, private or link-local host, in IPv4, in IPv6, or in IPv4 written as IPv6."""
    host = url_host(url)
    local = host.rlike(r"^(localhost|127\..*|10\..*|192\.168\..*|172\.(1[6-9]|2[0-9]|3[01])\..*|169\.254\..*|0\.0\.0\.0)$")
    local = local | host.rlike(r"^\[(::1?|(0+:)+0*1?|f[cd][0-9a-f]*:.*|fe[89ab][0-9a-f]:.*|.*:ffff:(7f.*|0?a[0-9a-f]{2}:.*|c0a8:.*|ac1[0-9a-f]:.*|a9fe:.*|127\..*|10\..*|192\.168\..*|172\.(1[6-9]|2[0-9]|3[01])\..*|169\.254\..*|0\.0\.0\.0))(%.*)?\]$")
    return F.coalesce(url.rlike("^https?://") & (host != "") & ~local, F.lit(False))


def heading_class(line: Column) -> Column:
    """The section that a heading names; the first class with a word that it contains."""
    # Classes in order, with their words.
    classes = (
        ("bugs", ("bug", "common mistake", "avoid", "pitfall", "error")),
        ("rules", ("rule", "session", "best practice", "guideline", "principle")),
        ("patterns", ("pattern", "technique", "method")),
        ("gotchas", ("gotcha", "warning", "caution", "note")),
        ("architecture", ("architecture", "map", "structure", "overview")),
    )
    low, found = F.lower(line), F.lit(None).cast("string")
    for name, words in reversed(classes):
        test = F.lit(False)
        for w in words:
            test = test | F.contains(low, F.lit(w))
        found = F.when(test, name).otherwise(found)
    return found


def capture_slug(text: Column, most: int = 60) -> Column:
    """Punctuation dropped, blanks to underscores."""
    return F.substring(F.regexp_replace(F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9 ]", "")), " +", "_"), 1, most)


def mechanical_summary(title: Column, symptom: Column) -> Column:
    """The title and the symptom's first sentence, or the title alone."""
    return F.when(symptom != "", F.concat(title, F.lit(": "), F.substring(F.substring_index(symptom, ".", 1), 1, 100))).otherwise(F.substring(title, 1, 120))


def accepted_citation(confidence: Column, changed: Column, url: Column) -> Column:
    return (confidence >= 0.7) & changed & F.coalesce(url.rlike("^https://"), F.lit(False))


def provenance_chain(steps: Column) -> Column:
    """``jar (date)`` of each step, joined by arrows."""
    return F.array_join(F.transform(steps, lambda x: F.concat(x["jar"], F.lit(" ("), x["date"], F.lit(")"))), " → ")
