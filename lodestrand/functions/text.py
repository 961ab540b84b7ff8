"""Scalar functions over text, identifiers and citations, as column expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import TERM_PREFIXES


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def falsy_null(x: Column | str) -> Column:
    """Null for an empty text."""
    return F.nullif(_c(x), F.lit(""))


def strip(x: Column | str) -> Column:
    """Without white space at both ends; SQL's trim takes blanks only."""
    return F.regexp_replace(_c(x), r"^\s+|\s+$", "")


def collapse(x: Column | str) -> Column:
    """White space runs to one blank, none at the ends."""
    return F.regexp_replace(strip(x), r"\s+", " ")


# identifiers
def chunk_id(species: Column | str, source: Column | str, index: Column | str) -> Column:
    """16 hex digits over species, source and index."""
    return F.substring(F.sha2(F.concat_ws("|", _c(species), _c(source), _c(index).cast("string")), 256), 1, 16)


def entity_id(kind: Column | str, surface: Column | str) -> Column:
    """16 hex digits over the type and the lower-cased surface form, without the species."""
    return F.substring(F.sha2(F.concat(F.upper(_c(kind)), F.lit(":"), F.lower(strip(surface))), 256), 1, 16)


def canonical_doc_id(doi: Column | str, openalex: Column | str, title: Column | str) -> Column:
    """by DOI, else by OpenAlex id, else by a digest of the title; null without any."""
    title = falsy_null(collapse(F.lower(_c(title))))
    return F.coalesce(F.concat(F.lit("doi:"), F.lower(falsy_null(doi))), F.concat(F.lit("oa:"), falsy_null(openalex)), F.concat(F.lit("title:"), F.sha2(title, 256)))


def slug(x: Column | str) -> Column:
    """letters and digits, all else to underscores, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(_c(x)), r"[^\p{L}\p{N}]", "_"), r"^_+|_+$", "")


def scientific_name(x: Column | str) -> Column:
    """F14"""
    return F.lower(collapse(F.replace(_c(x), F.lit("_"), F.lit(" "))))


def trait_key(x: Column | str) -> Column:
    """white space collapsed, lower case."""
    return F.lower(collapse(x))


def relation_key(x: Column | str) -> Column:
    """trimmed, lower case, blanks and hyphens to one underscore."""
    return F.regexp_replace(F.lower(strip(x)), r"[\s\-]+", "_")


# ontology terms
_ALLOWED = "^(" + "|".join(TERM_PREFIXES) + "):"


def is_allowed_term(x: Column | str) -> Column:
    """Whether a term is of one of the namespaces in use."""
    return F.coalesce(_c(x).rlike(_ALLOWED), F.lit(False))


def iri_to_curie(iri: Column | str) -> Column:
    """the term named by an IRI: cut at the last underscore, else the last slash, else its tail; null if none is allowed."""
    x = _c(iri)
    tail = F.regexp_extract(x, r"([^/]*)$", 1)
    by_mark = F.concat(F.regexp_extract(x, r"([^/]*)_[^_]*$", 1), F.lit(":"), F.regexp_extract(x, r"_([^_]*)$", 1))
    by_slash = F.concat(F.regexp_extract(x, r"([^/]*)/[^/]*$", 1), F.lit(":"), tail)
    whole = F.replace(tail, F.lit("_"), F.lit(":"))
    return F.when(x.contains("_") & is_allowed_term(by_mark), by_mark).when(x.contains("/") & is_allowed_term(by_slash), by_slash).when(is_allowed_term(whole), whole)


def curie_fragment(x: Column | str) -> Column:
    """F7"""
    return F.replace(_c(x), F.lit(":"), F.lit("_"))


def term_prefix(x: Column | str) -> Column:
    """what stands before the colon, or UNKNOWN."""
    return F.when(_c(x).contains(":"), F.split(_c(x), ":")[0]).otherwise("UNKNOWN")


def rich_text(label: Column | str, synonyms: Column | str, definition: Column | str, curie: Column | str) -> Column:
    """F8: label, synonyms and definition in one text; the term's id if all are empty."""
    joined = F.concat(F.coalesce(_c(label), F.lit("")), F.lit(". "), F.array_join(F.coalesce(_c(synonyms), F.array().cast("array<string>")), " | "), F.lit(". "), F.coalesce(_c(definition), F.lit("")))
    return F.coalesce(falsy_null(F.regexp_replace(joined, r"^[. ]+|[. ]+$", "")), _c(curie))


def bound(x: Column | str, f: Callable[[Column], Column]) -> Column:
    """f of x, which is found once however often f names it: an array of one element binds it."""
    return F.get(F.transform(F.array(_c(x)), f), F.lit(0))


# model output
def unfence(x: Column | str) -> Column:
    """what a code fence anywhere in the text holds, else the text."""
    inner = lambda t: F.nullif(F.regexp_extract(t, r"(?is)```(?:json)?\s*(.*?)```", 1), F.lit(""))
    # without a fence there is nothing to look for
    return bound(x, lambda t: strip(F.coalesce(F.when(F.contains(t, F.lit("```")), bound(inner(t), lambda i: i)), t)))


def without_thoughts(x: Column | str) -> Column:
    """F11"""
    return F.regexp_replace(_c(x), r"(?s)<think>.*?</think>", "")


def fill_template(template: Column | str, values: dict[str, Column]) -> Column:
    """every {name} replaced literally, in order."""
    return reduce(lambda t, kv: F.replace(t, F.lit("{" + kv[0] + "}"), kv[1]), values.items(), _c(template))


# citations
def citation(doc: Column | str, index: Column | str) -> Column:
    """the tag of a chunk."""
    return F.format_string("[source: %s|chunk:%s]", _c(doc).cast("string"), _c(index).cast("string"))


def parse_citation(tag: Column | str) -> Column:
    """a tag's doc and chunk; null for what is no tag."""
    form = r"^\s*\[?source:\s*([^|\]]+?)\s*\|\s*chunk:\s*([0-9]+)\s*\]?\s*$"
    return F.when(_c(tag).rlike(form), F.struct(F.regexp_extract(_c(tag), form, 1).alias("doc_id"), F.regexp_extract(_c(tag), form, 2).cast("int").alias("chunk_index")))


def comma_list(x: Column | str) -> Column:
    """Names of a comma list, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(_c(x), ","), strip), lambda v: v != "")


def word_count(x: Column | str) -> Column:
    return F.regexp_count(_c(x), F.lit(r"\S+"))


# documents
# Headings after which a paper's text is over.
REFERENCE_HEADINGS = r"(?i)\n\s*(References|Bibliography|Literature\s+Cited|Works\s+Cited|Acknowledgements?)\s*\n"


def strip_references(x: Column | str) -> Column:
    """the text before the first heading of a reference section that has a line to itself."""
    return F.split(_c(x), REFERENCE_HEADINGS, 2)[0]


# Fixed value: how captions begin.
CAPTION = r"(?i)^(fig(ure)?s?\.?|table|supplementary\s+(fig(ure)?|table)|supp\.)\s*[0-9\w]"


def junk_signals(x: Column | str) -> dict[str, Column]:
    """Five signs that a chunk has no content."""
    t = strip(x)
    words, chars = word_count(t), F.length(t)
    digits = F.regexp_count(t, F.lit("[0-9]"))
    lines = F.filter(F.transform(F.split(t, r"\r\n|\n|\r"), strip), lambda v: v != "")
    listed = F.size(F.filter(lines, lambda v: v.rlike(r"^[0-9\[{]")))
    ends = F.regexp_count(t, F.lit(r"[.!?]\s")) + F.when(t.rlike(r"[.!?]\z"), 1).otherwise(0)
    return {
        "s1": words < 20,
        "s2": (words < 50) & t.rlike(CAPTION),
        "s3": (chars > 0) & (digits > F.lit(0.30) * chars),
        "s4": (F.size(lines) >= 3) & (listed >= F.lit(0.40) * F.size(lines)),
        "s5": (ends < 2) & (words < 40),
    }


def is_junk_chunk(x: Column | str) -> Column:
    """At least two signs."""
    return reduce(lambda a, b: a + b, (F.coalesce(s.cast("int"), F.lit(0)) for s in junk_signals(x).values())) >= 2


def junk_entity_reason(x: Column | str) -> Column:
    """Why a surface form is dropped, by the first rule that holds; null if it stays."""
    t = _c(x)
    return (
        F.when(F.length(t) < 3, "too_short")
        .when(t.rlike(r"(?i)\bet\s+al\b"), "citation_et_al")
        .when(t.rlike(r"^[A-Z][a-z]+(?:\s+and\s+[A-Z][a-z]+)?\s+[0-9]{4}$"), "author_year")
        .when(t.rlike(r"^[0-9]"), "starts_with_digit")
        .when(t.rlike(r"(?i)^(?:XM_|XP_|NM_|NP_|contig)[0-9]+"), "accession_id")
        .when(t.rlike(r"[^\x00-\x7F]"), "non_ascii")
    )


def long_enough(x: Column | str, least: int) -> Column:
    """P5"""
    return F.length(strip(x)) >= least


def plural_pair(a: Column | str, b: Column | str) -> Column:
    """P10: whether two forms differ by a final s only."""
    x, y = F.lower(strip(a)), F.lower(strip(b))
    return (F.concat(x, F.lit("s")) == y) | (F.concat(y, F.lit("s")) == x)


def clamp(x: Column) -> Column:
    """F18"""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def best_pdf_url(best: Column | str, primary: Column | str, locations: Column | str) -> Column:
    """Of the best open location, any open one, the primary, any at all; the DOI service is the caller's last resort."""
    url = lambda s: falsy_null(_c(s).getField("pdf_url"))
    first = lambda cond: F.get(F.transform(F.filter(_c(locations), cond), lambda s: s["pdf_url"]), F.lit(0))
    has = lambda s: F.coalesce(s["pdf_url"], F.lit("")) != ""
    return F.coalesce(url(best), first(lambda s: F.coalesce(s["is_oa"], F.lit(False)) & has(s)), url(primary), first(has))


def hit_score(name: Column | str, title: Column | str, snippet: Column | str) -> Column:
    """How well a search hit fits a name."""
    n, t, s = F.lower(_c(name)), F.lower(F.coalesce(_c(title), F.lit(""))), F.lower(F.coalesce(_c(snippet), F.lit("")))
    tokens = F.filter(F.split(n, r"\s+"), lambda v: v != "")
    points = lambda cond, k: F.when(cond, k).otherwise(0)
    every = (F.size(tokens) > 0) & F.forall(tokens, lambda v: F.instr(t, v) > 0)
    return points(t == n, 5) + points(F.instr(t, n) > 0, 3) + points(every, 2) + points(F.instr(s, n) > 0, 1) - points(t.contains("genus") | s.contains("genus"), 2)


def specificity(species: Column | str, all_species: Column | int, fan_in: Column | str, max_fan_in: Column | str) -> Column:
    """breadth times information content; terms without a fan-in have a fixed content."""
    n = all_species if isinstance(all_species, Column) else F.lit(all_species)
    ic = F.when(_c(fan_in) >= 0, F.log((_c(max_fan_in) + 1) / (_c(fan_in) + 1))).otherwise(F.lit(2.0))
    return _c(species) / n * ic
