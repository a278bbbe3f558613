"""Text rules as Column expressions: normal forms, classifiers, counts and guesses."""

from __future__ import annotations

from difflib import SequenceMatcher
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def title_key(title: Column) -> Column:
    """Lower case, everything but a-z and 0-9 as single spaces."""
    return F.trim(F.regexp_replace(F.lower(title), "[^a-z0-9]+", " "))


def bibliography_key(text: Column) -> Column:
    """Lower case without web addresses, everything but letters, digits and underscore as single spaces."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?i)https?://\S+", " ")
    return F.trim(F.regexp_replace(F.lower(bare), r"(?U)[^\w]+", " "))


def _share_from(x: str | None, y: str | None, least: float) -> float | None:
    """The matching share, None below the least: the letters in common, however ordered, bound it first."""
    if x is None or y is None:
        return None
    match = SequenceMatcher(None, x, y)
    if least > 0 and (match.real_quick_ratio() < least or match.quick_ratio() < least):
        return None
    share = match.ratio()
    return share if share >= least else None


def matching_share(a: Column, b: Column, least: float = 0.0) -> Column:
    """Twice the length of the matching blocks of two texts over the length of both (Ratcliff-Obershelp), null below the least; equal texts stay in the JVM."""

    @F.pandas_udf(T.DoubleType())
    def share(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([_share_from(p, q, least) for p, q in zip(x, y, strict=True)], dtype="float64")

    return F.when(a == b, F.lit(1.0)).otherwise(share(a, b))


def title_similarity(a: Column, b: Column) -> Column:
    """The matching share of two titles' keys; 0 where one has none."""
    x, y = title_key(F.coalesce(a, F.lit(""))), title_key(F.coalesce(b, F.lit("")))
    return F.when((x == "") | (y == ""), F.lit(0.0)).otherwise(matching_share(x, y))


#: Frequent short words by language. Fixed values.
MARKERS = {
    "en": ("the", "and", "of", "in", "with"),
    "de": ("der", "die", "und", "von", "mit"),
    "fr": ("le", "la", "et", "de", "avec"),
    "es": ("el", "la", "y", "de", "con"),
}
_IN_WORD = r"[\p{L}\p{N}_]"


def _whole_words(text: Column, pattern: str) -> Column:
    """How often words of the pattern stand alone in a lower-cased text."""
    return F.regexp_count(F.lower(F.coalesce(text, F.lit(""))), F.lit(rf"(?<!{_IN_WORD})(?:{pattern})(?!{_IN_WORD})"))


def language_detail(text: Column, least_words: int = 20, least_markers: int = 2) -> Column:
    """Struct of language, confidence (share of all marker words) and method; no language for short texts, few markers or a tie.

    Markers are counted by one pass of a pattern each, so that no array of words is made.
    """
    counts = {k: _whole_words(text, "|".join(words)) for k, words in MARKERS.items()}
    best = F.greatest(*counts.values())
    ties = reduce(lambda a, b: a + b, [(c == best).cast("int") for c in counts.values()])
    total = reduce(lambda a, b: a + b, counts.values())
    name = F.coalesce(*[F.when(c == best, F.lit(k)) for k, c in counts.items()])
    # Letters and other numbers than decimal digits.
    long_enough = _whole_words(text, r"[\p{L}\p{Nl}\p{No}]+") >= least_words
    none = F.lit(None).cast("string")

    def made(language: Column, confidence: Column, method: str) -> Column:
        return F.struct(language.alias("language"), confidence.alias("confidence"), F.lit(method).alias("method"))

    method = "marker-abstention/1"
    return (
        F.when(~long_enough, made(none, F.lit(0.0), "insufficient-text"))
        .when((best < least_markers) | (ties > 1), made(none, F.lit(0.0), method))
        .otherwise(made(name, best.cast("double") / total, method))
    )


def language_guess(text: Column, least_words: int = 20, least_markers: int = 2) -> Column:
    """The language with most marker words; null for short texts, few markers or a tie."""
    return language_detail(text, least_words, least_markers)["language"]


def _cascade(value: Column, cases: tuple[tuple[str, str], ...], otherwise: Column) -> Column:
    """The label of the first pattern that the lower-cased value holds."""
    low = F.lower(F.coalesce(value, F.lit("")))
    out = None
    for pattern, label in cases:
        out = F.when(low.rlike(pattern), F.lit(label)) if out is None else out.when(low.rlike(pattern), F.lit(label))
    return out.otherwise(otherwise)


def outcome_class(value: Column) -> Column:
    """accepted, rejected, withdrawn or other_or_unresolved, by the beginning of a native outcome."""
    return _cascade(F.trim(value), ((r"^(accept|conditional accept|conditionally accept|strong accept)", "accepted"), (r"^reject", "rejected"), (r"^withdraw", "withdrawn")), F.lit("other_or_unresolved"))


def independent_outcome(value: Column) -> Column:
    """accepted, selected, rejected, withdrawn or null where the native text names no outcome; acceptance counts first."""
    cases = ((r"^(publish|published|selected)$", "selected"), (r"accept|poster|spotlight|oral", "accepted"), (r"reject|decline", "rejected"), (r"withdraw", "withdrawn"))
    return _cascade(F.trim(value), cases, F.lit(None).cast("string"))


def evaluation_class(kind: Column, official: Column, invitation: Column) -> Column:
    """Struct of an evaluation's class and official status."""
    both = F.concat_ws(" ", F.coalesce(kind, F.lit("")), F.coalesce(invitation, F.lit("")))
    named = _cascade(
        both,
        (
            (r"meta|editor|assessment", "editorial_or_meta_evaluation"),
            (r"office action|examiner", "patent_office_action"),
            (r"panel|funder", "funding_panel_evaluation"),
            (r"^(?!.*official)(?=.*comment)", "public_comment"),
            (r"review|report", "peer_review"),
        ),
        F.lit("other_evaluation"),
    )
    status = F.when(official, "official").when(~official, "not_official").when(named == "public_comment", "not_official_by_type").otherwise("unspecified")
    return F.struct(named.alias("evaluation_class"), status.alias("official_status"))


def invitation_role(invitations: Column) -> Column:
    """What a note is, by its invitations (an array)."""
    joined = F.array_join(F.coalesce(invitations, F.array().cast("array<string>")), " ")
    cases = (
        (r"(?s)(?=.*ethic)(?=.*review)", "ethics_review"),
        (r"meta_review|metareview", "meta_review"),
        (r"review", "official_review"),
        (r"decision|recommendation", "decision"),
        (r"rebuttal|author_response|author-response", "author_response"),
        (r"revision", "revision"),
        (r"comment|discussion", "public_comment"),
        (r"withdraw", "withdrawal"),
        (r"desk_reject", "desk_rejection"),
        (r"submission", "submission"),
    )
    return _cascade(joined, cases, F.lit("auxiliary"))


def comment_role(doi: Column, title: Column, subtype: Column) -> Column:
    """Who wrote a comment: by the last part of its DOI, else by its title and subtype."""
    last = F.substring_index(F.coalesce(doi, F.lit("")), "-", -1)
    named = F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(subtype, F.lit("")))
    words = (("referee", "referee_comment"), ("author", "author_comment"), ("editor", "editor_comment"), ("community", "community_comment"))
    marks = ((r"^rc\d+$", "referee_comment"), (r"^ac\d+$", "author_comment"), (r"^cc\d+$", "community_comment"), (r"^ec\d+$", "editor_comment"), (r"^sc\d+$", "short_comment"))
    return _cascade(last, marks, _cascade(named, words, F.lit("comment_unresolved")))


def selection_context(venue: Column) -> Column:
    """The kind of selection process that a venue's name tells."""
    cases = (
        (r"research_fund|oi_fund", "funding"),
        (r"competition|challenge", "competition"),
        (r"workshop", "workshop"),
        (r"conference", "conference"),
        (r"proceedings", "proceedings"),
        (r"papers", "journal_or_series"),
        (r"university|hackathon|research_camp", "course_or_training"),
    )
    return _cascade(venue, cases, F.lit("other_selection_process"))


def provider_status(notice: Column) -> Column:
    """What a provider's notice says of a discussed manuscript."""
    text = F.trim(F.regexp_replace(F.lower(F.coalesce(notice, F.lit(""))), r"(?U)\s+", " "))
    rejected = r"revision was not accepted|not accepted for further review after discussion|(preprint|manuscript|paper|revision) (was|has been|is) rejected|not accepted for publication|final status[^.]{0,80}rejection"
    cases = (
        (rejected, "affirmative_rejected_after_public_discussion"),
        (r"withdrawn by the authors", "affirmative_author_withdrawal_after_public_discussion"),
        (r"has been retracted", "affirmative_retraction_after_public_discussion"),
        (r"revision for further review has not been submitted|a final paper is not foreseen", "affirmative_discontinued_after_public_discussion"),
        (r"under review", "provider_visible_review_ongoing_censored"),
        (r".", "provider_status_other_censored"),
    )
    return _cascade(text, cases, F.lit("public_discussion_outcome_unresolved_censored"))


#: Kinds of invitations by what their names hold, and which kind goes before which. Fixed values.
INVITATION_KINDS = (
    (r"desk_reject|decision|recommendation", "decision"),
    (r"review", "evaluation"),
    (r"rebuttal|author_response|revision|comment", "discussion"),
    (r"withdraw", "withdrawal"),
    (r"submission", "submission"),
)
INVITATION_PRIORITY = ("unknown", "submission", "discussion", "evaluation", "withdrawal", "decision")


def invitation_kind(invitation: Column) -> Column:
    """decision, evaluation, discussion, withdrawal, submission or unknown."""
    return _cascade(invitation, INVITATION_KINDS, F.lit("unknown"))


def primary_invitation(invitation: Column, invitations: Column, venue_id: Column, fallback: Column) -> Column:
    """A note's typed invitation: the single one; else the last that names the venue's state; else the last of the most telling kind; else the fallback."""
    listed = F.filter(F.coalesce(invitations, F.array().cast("array<string>")), lambda v: v.isNotNull() & (v != ""))
    tail = lambda v: F.lower(F.substring_index(F.regexp_replace(v, "/+$", ""), "/", -1))
    state = F.when(F.coalesce(venue_id, F.lit("")) != "", tail(venue_id))
    same = F.filter(listed, lambda v: tail(v) == state)
    order = F.array(*map(F.lit, INVITATION_PRIORITY))
    best = F.array_max(F.transform(listed, lambda v, i: F.struct(F.array_position(order, invitation_kind(v)).alias("priority"), i.alias("position"), v.alias("v"))))["v"]
    return F.coalesce(F.when(invitation != "", invitation), F.when(F.size(same) > 0, F.element_at(same, -1)), best, fallback, F.lit("unknown"))


def public_configuration(content: Column) -> Column:
    """The entries of a map whose keys are of public settings, without those of contacts."""
    allowed = "submission|review|decision|comment|rebuttal|response|revision|withdraw|desk_reject|public_|venue|title|date"
    return F.map_filter(content, lambda k, _: F.lower(k).rlike(allowed) & ~F.lower(k).rlike("email|contact|message_sender"))


#: Broad fields and what native labels of them hold. Fixed values.
FIELDS: dict[str, tuple[str, ...]] = {
    "computer science": ("cs", "machine learning", "artificial intelligence", "informatics"),
    "physics": ("physics", "hep", "quantum", "astrophysics", "condensed matter"),
    "mathematics": ("math", "mathematics", "statistics"),
    "engineering": ("engineering", "electrical", "mechanical", "chemical engineering"),
    "biology and medicine": ("biology", "biomedical", "medicine", "health", "life science"),
    "earth and environmental sciences": ("earth", "climate", "geoscience", "environment", "atmospheric"),
    "social sciences": ("social science", "economics", "psychology", "sociology", "political"),
}
#: Constructs of rubrics, by what a label holds, and by whole words of a text. Fixed values.
RUBRIC_TERMS: dict[str, tuple[str, ...]] = {
    "novelty_originality": ("novel", "original", "new contribution"),
    "significance_interest": ("significance", "impact", "interest", "importance"),
    "soundness_evidence": ("sound", "correct", "evidence", "validity", "rigor"),
    "clarity": ("clarity", "presentation", "writing"),
    "reproducibility": ("reproduc", "replicab", "code", "data availability"),
    "ethics": ("ethic", "responsible", "harm"),
    "confidence": ("confidence", "expertise"),
    "overall_recommendation": ("rating", "recommend", "overall", "score"),
}
CONSTRUCT_WORDS: dict[str, tuple[str, ...]] = {
    "novelty_originality": ("novel", "novelty", "original", "originality"),
    "significance_interest": ("significance", "impact", "importance", "interest"),
    "soundness_evidence": ("soundness", "correctness", "evidence", "rigor", "rigour"),
    "clarity": ("clarity", "presentation", "writing", "readability"),
    "reproducibility": ("reproducibility", "replicability", "code", "data availability"),
    "ethics": ("ethics", "ethical", "responsible research"),
    "confidence": ("confidence", "expertise"),
    "overall_recommendation": ("overall", "recommendation", "rating", "score"),
    "risk_feasibility": ("risk", "feasibility", "feasible"),
}


def _holding(value: Column, terms: dict[str, tuple[str, ...]]) -> Column:
    low = F.lower(F.coalesce(value, F.lit("")))
    holds = {k: reduce(lambda a, b: a | b, [low.contains(t) for t in ts]) for k, ts in terms.items()}
    return F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in holds.items()]))


def field_matches(label: Column) -> Column:
    """The broad fields that a native label names."""
    return _holding(label, FIELDS)


def field_of(label: Column) -> Column:
    """Struct of the broad field and a score: 1 where just one is named, else null and 0."""
    found = field_matches(label)
    single = F.size(found) == 1
    return F.struct(F.when(single, F.get(found, F.lit(0))).alias("normalized_label"), F.when(single, 1.0).otherwise(0.0).alias("score"))


def field_candidates(label: Column) -> Column:
    """Array of (normalized_label, score): every broad field that is named, each with an equal share; one of null and 0 if none is."""
    found = field_matches(label)
    each = F.transform(found, lambda f: F.struct(f.alias("normalized_label"), (F.lit(1.0) / F.size(found)).alias("score")))
    none = F.array(F.struct(F.lit(None).cast("string").alias("normalized_label"), F.lit(0.0).alias("score")))
    return F.when(F.size(found) > 0, each).otherwise(none)


def rubric_constructs(label: Column, definition: Column | None = None) -> Column:
    """The constructs that a rubric's label and definition name, in order."""
    both = label if definition is None else F.concat_ws(" ", F.coalesce(label, F.lit("")), F.coalesce(definition, F.lit("")))
    return F.array_sort(_holding(both, RUBRIC_TERMS))


def construct_spans(text: Column) -> Column:
    """Array of (construct, span_start, span_end): of each construct the first whole-word mention, code points, end exclusive; the shorter of two that start together."""
    low = F.lower(F.coalesce(text, F.lit("")))

    def first(term: str) -> Column:
        pattern = rf"(?<!{_IN_WORD})\Q{term}\E(?!{_IN_WORD})"
        at = F.regexp_instr(low, F.lit(pattern))
        return F.when(at > 0, F.struct((at - 1).alias("span_start"), (at - 1 + len(term)).alias("span_end")))

    spans = []
    for construct, terms in CONSTRUCT_WORDS.items():
        best = F.array_min(F.array_compact(F.array(*map(first, terms))))
        spans.append(F.when(best.isNotNull(), F.struct(F.lit(construct).alias("construct"), best["span_start"].alias("span_start"), best["span_end"].alias("span_end"))))
    return F.array_compact(F.array(*spans))


#: Hosts of research objects. Fixed values.
REPOSITORIES = r"(?i)https?://(?:www\.)?(?:github\.com|gitlab\.com|zenodo\.org|osf\.io|figshare\.com|datadryad\.org|doi\.org)/[^\s<>\]\[\)\(\"']+"


def repository_links(text: Column) -> Column:
    """Array of (url, host) of the research objects that a text links to, without closing punctuation."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(REPOSITORIES), F.lit(0))
    return F.transform(found, lambda u: F.struct(F.regexp_replace(u, r"[.,;)]+$", "").alias("url"), F.lower(F.regexp_extract(u, r"(?i)^https?://(?:www\.)?([^/]+)/", 1)).alias("host")))


#: Kinds of statements and their patterns. Fixed values.
CLAIMS: dict[str, str] = {
    "contribution_claim": r"(?i)\b(?:we (?:show|find|demonstrate|propose|introduce)|this (?:work|paper|study) (?:shows|finds|introduces))\b",
    "method": r"(?i)\b(?:method|algorithm|experiment|simulation|regression|survey|dataset)\b",
    "evidence_type": r"(?i)\b(?:randomi[sz]ed|observational|qualitative|quantitative|benchmark|case study)\b",
    "limitation": r"(?i)\b(?:limitation|limited by|future work|cannot establish|uncertain)\b",
    "data_or_code": r"(?i)\b(?:code|data|repository|github|zenodo|osf)\b",
}


def claim_counts(text: Column) -> dict[str, Column]:
    """How often a text makes each kind of statement."""
    return {k: F.regexp_count(F.coalesce(text, F.lit("")), F.lit(p)) for k, p in CLAIMS.items()}


def canonical_licence(value: Column) -> Column:
    """The usual name of a licence given by a Creative Commons address or a label; other texts stay, null and empty ones are null."""
    low = F.lower(F.trim(value))
    pattern = r"creativecommons\.org/(?:publicdomain/zero|licenses)/(by(?:-nc)?(?:-sa)?|zero)/([1-4](?:\.0)?)"
    family, version = F.regexp_extract(low, pattern, 1), F.regexp_extract(low, pattern, 2)
    label = F.translate(low, "_ ", "--")
    label = F.when(label.isin("creative-commons-attribution-4.0", "cc-by"), "cc-by-4.0").otherwise(label)
    return (
        F.when(F.coalesce(value, F.lit("")) == "", None)
        .when(family == "zero", "CC0")
        .when(family != "", F.concat(F.lit("cc-"), family, F.lit("-"), version))
        .when(label.startswith("cc-"), F.upper(label))
        .otherwise(F.trim(value))
    )


#: Licences whose objects may be passed on, and those that may in a package of their own. Fixed values.
OPEN = ("cc0", "cc-by-4.0", "cc-by-3.0", "public-domain", "mit", "apache-2.0")
SEPARATE = ("cc-by-nc-sa-4.0", "cc-by-sa-4.0")
SENSITIVE = ("email", "contact", "authorization")


def release_decision(object_type: Column, licence: Column, source_allows: Column, reconstructive: Column | None = None) -> Column:
    """Struct of release_class, canonical licence, attribution, share_alike, noncommercial and reason.

    A source that forbids passing on comes first, then open licences, then those for separate
    packages; of anything else only derived features are safe, and of sensitive objects, or
    features that would give the object back, nothing.
    """
    canonical = canonical_licence(licence)
    name = F.replace(F.lower(F.trim(F.coalesce(canonical, F.lit("")))), F.lit(" "), F.lit("-"))
    gives_back = F.lit(False) if reconstructive is None else F.coalesce(reconstructive, F.lit(False))

    def made(kind: str, reason: str, attribution: Column = F.lit(False), alike: Column = F.lit(False), noncommercial: Column = F.lit(False)) -> Column:
        return F.struct(F.lit(kind).alias("release_class"), canonical.alias("licence"), attribution.alias("attribution"), alike.alias("share_alike"), noncommercial.alias("noncommercial"), F.lit(reason).alias("reason"))

    alike, noncommercial = name.contains("-sa-"), name.contains("-nc-")
    return (
        F.when(source_allows == F.lit(False), made("pointer_hash", "source terms prohibit or do not authorize redistribution"))
        .when(name.isin(*OPEN), made("redistribute", "affirmative open licence", ~name.isin("cc0", "public-domain"), alike, noncommercial))
        .when(name.isin(*SEPARATE), made("redistribute", "redistributable in a separately compatible package", F.lit(True), alike, noncommercial))
        .when(~gives_back & ~F.coalesce(object_type, F.lit("")).isin(*SENSITIVE), made("derived_only", "licence unresolved; only non-reconstructive derived features and pointer/hash are safe"))
        .otherwise(made("exclude", "unknown rights or sensitive/reconstructive object"))
    )


def release_class(object_type: Column, licence: Column, source_allows: Column, reconstructive: Column | None = None) -> Column:
    """redistribute, pointer_hash, derived_only or exclude."""
    return release_decision(object_type, licence, source_allows, reconstructive)["release_class"]


def declared_release(object_type: Column, licence: Column, declared: Column) -> Column:
    """The class of an object that a source has classed itself: a stricter class stands, a claim to redistribute needs a licence that allows it."""
    claimed = declared == "redistribute"
    decided = release_class(object_type, licence, F.when(claimed, F.lit(True)))
    return F.when(declared.isin("pointer_hash", "derived_only", "exclude"), declared).when(claimed & (decided != "redistribute"), "pointer_hash").otherwise(decided)


def claim_numbers(claims: Column) -> Column:
    """Struct of claims by their leading number (the first of each), and the numbers that several claims have; claims without a number are left out."""
    number = lambda c: F.regexp_extract(c, r"^\s*(\d+)\s*[.)]", 1)
    listed = F.filter(F.coalesce(claims, F.array().cast("array<string>")), lambda c: number(c) != "")
    numbers = F.transform(listed, lambda c: number(c).cast("int"))
    once = F.array_distinct(numbers)
    by = F.map_from_arrays(once, F.transform(once, lambda n: F.element_at(listed, F.array_position(numbers, n).cast("int"))))
    twice = F.filter(once, lambda n: F.size(F.filter(numbers, lambda m: m == n)) > 1)
    return F.struct(by.alias("claims"), F.array_sort(twice).alias("ambiguous"))


def pointer_problems(source_url: Column, retrieval_target: Column, object_locator: Column, byte_hash: Column, text_hash: Column, verified: Column, automatic: Column) -> Column:
    """What is wrong with a pointer to an object: addresses that are not https, a missing locator, no digest that can be one, a digest that need not be checked, or a right to pass on by itself."""
    https = lambda c: F.coalesce(F.trim(c).rlike(r"^https://[^/?#\s]+"), F.lit(False))
    return F.array_compact(
        F.array(
            F.when(~https(source_url), F.lit("source_url")),
            F.when(~https(retrieval_target), F.lit("retrieval_target")),
            F.when(F.trim(F.coalesce(object_locator, F.lit(""))) == "", F.lit("object_locator")),
            F.when(~genuine_sha256(F.trim(byte_hash)) & ~genuine_sha256(F.trim(text_hash)), F.lit("expected_hash")),
            F.when(~F.coalesce(verified, F.lit(False)), F.lit("hash_verification_required")),
            F.when(F.coalesce(automatic, F.lit(False)), F.lit("automatic_redistribution_allowed")),
        )
    )


def genuine_sha256(value: Column) -> Column:
    """64 hexadecimal digits, not all the same."""
    return F.coalesce(F.lower(value).rlike("^[0-9a-f]{64}$") & (F.size(F.array_distinct(F.split(F.lower(value), ""))) > 1), F.lit(False))


def https_target(value: Column) -> Column:
    """An https URL with a host that has a dot."""
    return F.coalesce(value.rlike(r"^https://[^/?#\s]+\.[^/?#\s]+"), F.lit(False))


def first_number(text: Column) -> Column:
    """The first signed number in a text."""
    return F.regexp_extract(text, r"[-+]?\d+(?:\.\d+)?", 0).try_cast("double")


_WEEKDAY = r"^(?:[A-Za-z]{3},\s*)?"


def moment(value: Column) -> Column:
    """A time from a year, an ISO date or time, or a mail header's date, in UTC; null for anything else."""
    v = F.trim(value)
    mail = F.regexp_replace(v, _WEEKDAY, "")
    zoned = F.regexp_replace(mail, r"(?:GMT|UTC|UT|Z)$", "+0000")
    return F.coalesce(
        F.when(v.rlike(r"^\d{4}$"), F.try_to_timestamp(F.concat(v, F.lit("-01-01")), F.lit("yyyy-MM-dd"))),
        F.when(v.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_timestamp(v)),
        F.when(zoned.rlike(r"^\d{1,2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2} [+-]\d{4}$"), F.try_to_timestamp(zoned, F.lit("d MMM yyyy HH:mm:ss Z"))),
    )


def epoch_moment(value: Column) -> Column:
    """A time from milliseconds since 1970, given as a number or a text."""
    return F.timestamp_micros((value.try_cast("double") * 1000).cast("long"))


def year_quarter(at: Column) -> Column:
    """Struct of year and quarter; 1970 and 1 without a time."""
    return F.struct(F.coalesce(F.year(at), F.lit(1970)).alias("year"), F.coalesce(F.quarter(at), F.lit(1)).alias("quarter"))
